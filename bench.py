"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``BENCH_QUERIES=all`` times the whole catalogue. Every result is computed in
full (a no-op sink takes all columns of all rows). Each query runs twice and
the second run counts; the first one warms the JVM up.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = """
text_per_host chunk_regex chunk_sliding chunk_overlap chunk_topics main_content best_text
robots_join top_k_urls first_nonempty_provider links quality_scores extract_labels extract_terms
normalize_text dedupe_exact metric_by_period evaluate_goals run_status_counts latest_status
resume_join assign_ids accepted_rows upsert_by_pk target_assembly harvest_chunks known_refs
dependency_levels
""".split()


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from sheafline.plans.catalog import QUERIES
    from sheafline.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else (wanted.split(",") if wanted else HEADLINE)
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=cpus,
        spark__sheafline__scanTasks=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            df = QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds, headline queries",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
