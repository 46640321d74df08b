"""Exploratory profile job: every EDA table of the analysis, written as Parquet.

    spark-submit jobs/eda_tables.py --data-dir <dir> --output-dir <dir> [--layout csv|tables]

Each table is one Spark plan over the flights fact (the same operators the
registered queries use); nothing is collected to the driver except one-row
aggregates.
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from skylag import config as C  # noqa: E402
from skylag.functions import exprs as X  # noqa: E402
from skylag.operators import clean as P  # noqa: E402
from skylag.operators import features as FE  # noqa: E402
from skylag.operators import lookups as J  # noqa: E402
from skylag.operators import profile as PR  # noqa: E402
from skylag.operators import stats as A  # noqa: E402


def tables(raw: DataFrame) -> dict[str, DataFrame]:
    """Name -> DataFrame of every exploratory table (lazy)."""
    eda = FE.with_route_and_hours(P.eda_filter(raw))
    eda_flags = FE.add_calendar_flags(eda)
    traffic = A.airport_traffic(eda)
    hubs = A.hub_airports(eda, C.EDA_HUB_QUANTILE)
    with_hubs = J.add_hub_flags(eda, hubs)
    nb_dist = (F.when(F.col("DISTANCE") < 500, "short (<500mi)").when(F.col("DISTANCE") < 1500, "medium (500-1500mi)")
                .otherwise("long (>1500mi)"))
    top = PR.top_routes(eda).select("ROUTE")
    return {
        "missing_values": PR.missing_profile(raw),
        "delay_histogram": PR.histogram(eda),
        "delay_classes": PR.delay_class_counts(eda),
        "late_pct": PR.overall_late_pct(eda),
        "by_dep_hour": PR.above_group_mean(A.group_stats(eda, "DEP_HOUR", pct=True), "delay_rate"),
        "by_arr_hour": PR.above_group_mean(A.group_stats(eda, "ARR_HOUR", pct=True), "delay_rate"),
        "by_airline": PR.above_group_mean(A.group_stats(eda, "AIRLINE", pct=True), "delay_rate"),
        "top_routes": A.group_stats(P.in_key_set(eda, top, "ROUTE", key_rows=C.TOP_ROUTES), "ROUTE", pct=True),
        "route_ranges": A.min_max_of(A.group_stats(eda, "ROUTE"), "delay_mean"),
        "distinct_routes": A.distinct_count(eda, "ROUTE"),
        "airport_traffic": PR.traffic_table(traffic),
        "traffic_quantiles": A.exact_quantiles(traffic, "total_movements", [0.5, 0.75, 0.9, 0.95, 0.99],
                                               bounded=True),
        "distance_box": PR.box_summary(eda.withColumn("DISTANCE_CAT", X.distance_class_notebook("DISTANCE")),
                                       by=["DISTANCE_CAT"]),
        "distance_stats": PR.named_stats(eda.withColumn("DISTANCE_CAT", nb_dist), "DISTANCE_CAT"),
        "origin_hub_stats": PR.named_stats(with_hubs, "IS_ORIGIN_HUB"),
        "dest_hub_stats": PR.named_stats(with_hubs, "IS_DEST_HUB"),
        "hub_combos": PR.hub_combo_rates(with_hubs),
        "best_worst_routes": PR.best_worst_routes(eda),
        "correlations_clean": PR.correlation_matrix(
            eda_flags, ["ARRIVAL_DELAY", "MONTH", "DAY_OF_WEEK", "DEP_HOUR", "DISTANCE", "IS_WEEKEND", "IS_SUMMER"]),
        "correlations_leakage": PR.correlation_matrix(eda, P.existing(eda, [
            "ARRIVAL_DELAY", "DEPARTURE_DELAY", "TAXI_OUT", "TAXI_IN", "AIR_TIME", "ELAPSED_TIME", "DISTANCE"])),
        "row_funnel": PR.row_funnel(raw),
    }


def run(spark: SparkSession, raw: DataFrame, output_dir: str) -> list[str]:
    from skylag.session import scratch_scope
    out = []
    with scratch_scope(spark, "eda"):          # intermediates removed once every table is written
        for name, df in tables(raw).items():
            df.write.mode("overwrite").parquet(f"{output_dir}/{name}")
            out.append(name)
    return out


def main(argv=None):
    ap = argparse.ArgumentParser(description="Write the exploratory delay tables")
    ap.add_argument("--data-dir", required=True)
    ap.add_argument("--output-dir", required=True)
    ap.add_argument("--layout", choices=["csv", "tables"], default="csv")
    a = ap.parse_args(argv)
    from jobs.train import load_flights
    from skylag.session import get_session
    spark = get_session()
    print(run(spark, load_flights(spark, a.data_dir, a.layout), a.output_dir))


if __name__ == "__main__":
    main()
