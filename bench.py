"""Benchmark of the headline queries.

Runs every headline query once on sf0.001 (JVM / codegen warm-up), then
times each one at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]``.  Each query is executed in full through the ``noop``
sink (no rows are pulled to the driver).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskfold.plans import catalog  # noqa: E402
from riskfold.session import build_session  # noqa: E402

HEADLINE = [
    "q_ticker_metrics_a", "q_ticker_metrics_b", "q_srisk_v1", "q_srisk_v2", "q_weights",
    "q_pie_cumsum", "q_ticker_search", "q_parse_portfolio", "q_extract_number", "q_clean_html",
    "q_pubdate_norm", "q_preprocess", "q_upsert_ignore", "q_recent_news", "q_content_filter",
    "q_page_extract", "q_topk_search", "q_dup_pairs", "q_dedupe_similar", "q_hash_encode",
    "q_index_build", "q_record_assemble", "q_backfill", "q_instruction_rows", "q_chat_render",
    "q_prompt_rows", "q_reports",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    spark = build_session(master=f"local[{cpus}]", app="riskfold-bench", shuffle_partitions=int(cpus))
    qs = catalog.queries()
    names = [n for n in HEADLINE if n in qs]
    for n in names:
        try:
            run(qs[n](spark, warm_dir))
        except Exception as e:  # noqa: BLE001
            print(f"warm-up {n} failed: {e!r}"[:300], file=sys.stderr)
    times: dict[str, float] = {}
    for n in names:
        t0 = time.perf_counter()
        try:
            run(qs[n](spark, sf_dir))
            times[n] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001
            print(f"{n} failed: {e!r}"[:300], file=sys.stderr)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus), "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
