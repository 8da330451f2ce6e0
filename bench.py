"""Times the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs in full into a no-op sink. Shared stage tables (evidence, picks, draft claims, rounds) are
built inside the first query that needs them and so count there.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sourceweave.plans import catalogue  # noqa: E402
from sourceweave.session import build_session  # noqa: E402

HEADLINE = [
    "evidence_by_source", "html_to_text", "chunk", "explode_chunks", "candidates_by_search", "discover_evidence", "cap_evidence",
    "put_many", "search_many", "extractive_draft", "resolve_citations", "rule_verify", "rewrite_rounds", "package_scores", "decide",
    "numeric_conflicts", "stage_durations", "job_transitions", "style_metrics", "repeated_ngrams", "excess_words", "tag_evidence",
    "cosine_rank", "relevance_cap", "recurate_triggers", "recurate_triggers_stream", "usage_sessions", "source_updates",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/region.parquet").count()  # start-up is not a query
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        start = time.time()
        catalogue.run(name, spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
