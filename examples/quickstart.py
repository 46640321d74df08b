"""End-to-end use of the library (what the original pipeline did, on Spark).

    python examples/quickstart.py /root/testdata/sf0.01 tables
    python examples/quickstart.py /path/to/csv_dir csv
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from skylag.operators import clean, encode, features, model, profile  # noqa: E402
from skylag.session import get_session  # noqa: E402


def main(data_dir: str, layout: str = "tables") -> None:
    from jobs.train import load_flights
    spark = get_session("local[*]")
    raw = load_flights(spark, data_dir, layout)                       # explicit schemas, existence check

    # exploratory tables are plain DataFrames
    profile.best_worst_routes(features.with_route_and_hours(clean.eda_filter(raw))).show()

    prepared = features.add_route_features(features.preprocess_flights(raw))
    train, test = clean.split_by_month(prepared)                      # months 1-10 / 11-12
    fm = encode.fit_features(train)                                   # statistics from train only
    quick = {"stepSize": 0.1, "maxDepth": 4, "maxIter": 10}
    m = model.fit_two_stage(train, fm, quick, quick)                  # weighted GBT + late-row regressor
    model.evaluate_two_stage(m, test).show(40, truncate=False)

    requests = spark.createDataFrame(
        [(12, 5, 20, 23, "N01", "N07", "A03", 199.2), (13, 5, 20, 23, "N01", "N07", "A03", 199.2)],
        "month int, day_of_week int, scheduled_departure_hour int, scheduled_arrival_hour int, "
        "origin_airport_code string, destination_airport_code string, airline_code string, distance double")
    model.score_requests(m, requests).show(truncate=False)           # second row is rejected (month 13)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2] if len(sys.argv) > 2 else "tables")
