"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "f3_search_pages", "f7_retrieve_multi", "e10_term_stats", "e3_sections", "f9_section_score", "f34_pack_context", "d5_measured_values",
    "k9_atomic_questions", "h9_judgments", "i7_calculate", "j9_summaries", "j14_quota",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--conf spark.ui.showConsoleProgress=false --conf spark.driver.memory=16g pyspark-shell")
    from leafscan.operators.stored_index import build_index
    from leafscan.plans import base, registry
    from leafscan.session import build_session, new_folder

    spark = build_session("leafscan-bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    wanted = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    times = {}
    start = time.time()
    base.markdown_index(spark, sf_dir)
    times["index_build"] = round(time.time() - start, 3)
    start = time.time()
    build_index(base.line_pages(spark, sf_dir), new_folder(spark, "bench-index"))  # a build of its own, whatever is stored already
    times["search_index_build"] = round(time.time() - start, 3)
    base.line_index(spark, sf_dir)
    for name in wanted:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
