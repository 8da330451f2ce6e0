"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged


#: Where a node has more links than this, the links of each node are dealt out to ``SALTS`` tasks.
HUB, SALTS = 4096, 16


def _least_neighbour(sides: DataFrame, hubs: bool) -> DataFrame:
    """``sides`` (u, v) with ``m``: the least of u and its neighbours. With ``hubs`` no task gets all links of a node."""
    if not hubs:
        return sides.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))
    near = sides.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).repartition("u", "salt")
    least = near.groupBy("u", "salt").agg(F.min("v").alias("m")).groupBy("u").agg(F.least("u", F.min("m")).alias("m"), F.collect_list("salt").alias("salts"))
    # never by broadcast: tables of all steps would go through the driver
    far = least.select("u", "m", F.explode("salts").alias("salt")).hint("merge")
    return near.join(far, ["u", "salt"]).drop("salt")


def _shape(edges: DataFrame) -> tuple[int, bool]:
    """Most links of a node of ``edges`` (u, v; u > v), and whether any v is no root or any u has two."""
    one, none = F.lit(1), F.lit(0)
    ends = edges.select(F.col("u").alias("node"), one.alias("down"), none.alias("up")).union(edges.select("v", none, one))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
    found = nodes.agg(F.max(F.col("down") + F.col("up")).alias("most"), F.max((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))).alias("open")).first()
    return found.most or 0, bool(found.open)


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (u, v): label is the least node it can reach.

    Large-star and small-star steps in turn, which end after about log squared of the longest path, as soon as every node
    hangs on its root. Each step is written, so plans stay short, and broadcasts nothing; only the greatest number of links
    and whether work is left reach the driver. An empty table gives an empty one.
    """
    edges = staged(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while True:
        most, more = _shape(edges)
        if not more:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both, most > HUB).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _least_neighbour(large, most > HUB)
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        edges = staged(moved.where("u <> v").distinct(), "links")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return staged(edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots), "labels")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` as :func:`components` gives them, with further ``links`` (u, v): only the components these touch are gone through."""
    of = {c: labels.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}")) for c in ("u", "v")}
    ends = links.join(of["u"], "u", "left").join(of["v"], "v", "left").select(F.coalesce("of_u", "u").alias("u"), F.coalesce("of_v", "v").alias("v"))
    moved = components(ends)
    now = moved.select(F.col("node").alias("label"), F.col("label").alias("now"))
    old = labels.join(now, "label", "left").select("node", F.coalesce("now", "label").alias("label"))
    return staged(old.union(moved.join(labels.select("node"), "node", "left_anti").select("node", "label")), "labels")
