"""Finding one JSON object inside a model response."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, strip

# How responses fence their JSON, with and without the language's name.
JSON_FENCE = r"(?s)```json\s*\n(.*)\n\s*```"
PLAIN_FENCE = r"(?s)```\s*\n(.*)\n\s*```"


def is_json(c: Column) -> Column:
    """Strict validity: the text must parse both as an only list element and as an only map value,

    which rules out the trailing text that the parser alone lets pass.
    """
    in_list = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))).isNotNull()
    in_map = F.try_parse_json(F.concat(F.lit('{"k":'), c, F.lit("}"))).isNotNull()
    return F.coalesce(in_list & in_map & (strip(c) != ""), F.lit(False))


def extract_json(response: Column) -> Column:
    """The JSON object of a response, or null: whole text, then a fenced block, then first { to last }.

    A whole text that is valid JSON but no object counts as unparsable.
    """

    def fence(text: Column, pattern: str, otherwise: Column) -> Column:
        inner = strip(F.regexp_extract(text, pattern, 1))
        return F.when(text.rlike(pattern), bind(inner, lambda c: F.when(is_json(c), c))).otherwise(otherwise)

    def braces(text: Column) -> Column:
        first = F.instr(text, "{")
        last = F.length(text) - F.instr(F.reverse(text), "}") + 1
        piece = bind(F.substring(text, first, last - first + 1), lambda c: F.when(is_json(c), c))
        return F.when((first > 0) & F.contains(text, F.lit("}")) & (last > first), piece)

    def search(text: Column) -> Column:
        # a fence that holds no JSON leaves the other fence to try, but never the bare braces
        plain = fence(text, PLAIN_FENCE, F.lit(None).cast("string"))
        found = (
            F.when(is_json(text), text)
            .when(text.rlike(JSON_FENCE), F.coalesce(fence(text, JSON_FENCE, F.lit(None).cast("string")), plain))
            .when(text.rlike(PLAIN_FENCE), plain)
            .otherwise(braces(text))
        )
        return bind(found, lambda c: F.when(F.startswith(c, F.lit("{")), c))

    newline = F.lit("\n")
    return bind(strip(F.replace(F.replace(response, F.lit("\r\n"), newline), F.lit("\r"), newline)), search)
