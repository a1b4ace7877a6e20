"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from quillon.operators.events import check_events  # noqa: E402
from quillon.plans.catalogue import QUERIES  # noqa: E402
from quillon.plans.windowing import event_json  # noqa: E402
from quillon.session import build_session, stored_for_a_while  # noqa: E402

HEADLINE = [
    "top_nations_in_region", "cube_measures", "cube_distinct_suppliers", "cube_drill_down",
    "join_three_sources", "features_valid_at", "features_latest_at", "events_enriched", "feature_expressions",
    "tumbling_aggregates", "tumbling_percentiles", "sliding_aggregates", "session_windows", "event_base_errors",
    "quality_suite", "profile_columns_documents", "profile_numeric", "profile_top_categories", "alert_cooldown",
    "lineage_downstream", "variant_stats", "variant_t_tests", "rank_sum_test", "chi_square_test",
    "numeric_baseline", "categorical_drift", "ks_per_feature", "psi_numeric",
    "classification_metrics", "batch_scoring", "run_summary", "metric_alert_transitions", "latency_summary",
]


def events_per_second(spark, folder: str, copies: int = 8) -> float:
    """Steady rate of decoding and checking JSON events, over a table of `copies` files of all events."""
    records = event_json(spark, folder).select("value")
    many = records
    for _ in range(copies - 1):
        many = many.unionAll(records)
    with stored_for_a_while(many.repartition(copies), "bench") as rows:
        start = time.perf_counter()
        check_events(rows).agg(F.count_if("is_valid"), F.count(F.lit(1))).collect()
        return rows.count() / (time.perf_counter() - start)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the executor
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    rate = events_per_second(spark, folder)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
                "events_per_second": round(rate),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
