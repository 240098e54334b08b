"""Time the headline queries and print one JSON line.

Each query runs once untimed on the smallest tables, so that class loading is not
measured, and once timed on ``$BENCH_SF_DIR``. All rows are computed; none are kept.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])

import catalog  # noqa: E402
from candrank.plans.session import local_session  # noqa: E402

HEADLINE = (
    "ingest_keep_first",
    "metadata_keep_last",
    "resume_presence",
    "state_upsert",
    "state_transitions",
    "queue_stage1",
    "status_counts",
    "meta_upsert",
    "page_assembly",
    "tiered_extract",
    "read_files",
    "rubric_violations",
    "rubric_block",
    "prompt_build",
    "request_chat_completion",
    "parse_tool_block",
    "parse_chat",
    "parse_local",
    "parse_envelope",
    "attempts_resolved",
    "validate_full",
    "validate_knockout",
    "single_stage_outcome",
    "two_stage_outcome",
    "scorer_rounds",
    "rank_full",
    "rank_full_by_runs",
    "rank_top_n",
    "rank_bundle",
    "ranked_files",
    "incremental_ingest",
    "end_to_end_single",
)


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "candrank-bench")
    spark.sparkContext.setLogLevel("ERROR")
    small = str(Path(sf_dir).parent / "sf0.001")
    names = sys.argv[1:] or HEADLINE
    every, times = catalog.queries(), {}
    for name in names:
        if os.path.isdir(small):
            consume(every[name](spark, small))
        start = time.perf_counter()
        consume(every[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
