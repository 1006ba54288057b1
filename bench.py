"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from hoardbook.plans.queries import QUERIES

HEADLINE = [
    "media_base", "media_recent", "media_count_by_genre", "media_cost_by_disk",
    "media_search_name", "media_dup_check", "media_title_spend", "game_base",
    "game_count_by_platform", "game_dup_check", "locate", "item_ledger", "ledger_collection",
    "box_pl", "portfolio", "allocate_cost", "box_median", "grade_candidates", "grading_scorecard",
    "grading_history", "grading_report", "intake_normalize", "intake_summary",
    "intake_expand_qty", "import_sealed", "import_append", "apply_changes", "cascade_delete",
    "orphans", "metadata_media_hits",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="hoardbook-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
