"""Filters, projections and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as X


def existing(df: DataFrame, cols) -> list[str]:
    """The listed columns that the frame has, in the listed order."""
    have = set(df.columns)
    return [c for c in cols if c in have]


def drop_leakage(df: DataFrame, cols=C.LEAKAGE_COLS) -> DataFrame:
    """Drop post-departure columns that are present."""
    return df.drop(*existing(df, cols))


def clean_flights(df: DataFrame, leakage_cols=C.LEAKAGE_COLS) -> DataFrame:
    """P1 (+P2): not cancelled, not diverted, delay/departure/tail present."""
    kept = df.filter(
        (F.col("CANCELLED") == 0) & (F.col("DIVERTED") == 0)
        & F.col("ARRIVAL_DELAY").isNotNull()
        & F.col("SCHEDULED_DEPARTURE").isNotNull()
        & F.col("TAIL_NUMBER").isNotNull())
    return drop_leakage(kept, leakage_cols)


def eda_filter(df: DataFrame) -> DataFrame:
    """Exploratory frame keeps diverted rows that have a delay."""
    return df.filter((F.col("CANCELLED") == 0) & F.col("ARRIVAL_DELAY").isNotNull())


def split_by_month(df: DataFrame, train=C.TRAIN_MONTHS, test=C.TEST_MONTHS,
                   month="MONTH") -> tuple[DataFrame, DataFrame]:
    """Temporal split; plain-column IN predicates reach the Parquet scan
    (and prune partitions when the table is written partitionBy(MONTH))."""
    return df.filter(F.col(month).isin(list(train))), df.filter(F.col(month).isin(list(test)))


def temporal_folds(df: DataFrame, folds=C.TEMPORAL_FOLDS, month="MONTH") -> DataFrame:
    """P5: expanding folds as a long table (fold, role, row columns...).

    Fold i trains on months <= a and validates on months b..c. A row can be
    in several folds, so rows are tagged by an explode of the folds it
    belongs to (no self-join, one pass)."""
    m = F.col(month)
    tags = []
    for i, (a, b, c) in enumerate(folds):
        tags.append(F.when(m <= a, F.struct(F.lit(i).alias("fold"), F.lit("train").alias("role"))))
        tags.append(F.when(m.between(b, c), F.struct(F.lit(i).alias("fold"), F.lit("validation").alias("role"))))
    arr = F.filter(F.array(*tags), lambda t: t.isNotNull())
    return (df.withColumn("_tag", F.explode(arr))
              .select(F.col("_tag.fold").alias("fold"), F.col("_tag.role").alias("role"), *df.columns))


def late_rows(df: DataFrame, y="ARRIVAL_DELAY", threshold=C.DELAY_THRESHOLD) -> DataFrame:
    """P7."""
    return df.filter(F.col(y) > threshold)


def select_features(df: DataFrame, features) -> DataFrame:
    """P8."""
    return df.select(*features)


def ensure_columns(df: DataFrame, required) -> DataFrame:
    """Required columns in order; absent ones become 0."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(0).alias(c) for c in required])


def add_missing_columns(df: DataFrame, required) -> DataFrame:
    """P9 for scoring: required columns that are absent become 0; all other
    columns are kept (they carry ids and outputs)."""
    have = set(df.columns)
    missing = {c: F.lit(0) for c in required if c not in have}
    return df.withColumns(missing) if missing else df


def min_support(df: DataFrame, count_col="count", n=C.MIN_ROUTE_SUPPORT) -> DataFrame:
    """P10: HAVING count >= n on an aggregate."""
    return df.filter(F.col(count_col) >= n)


def in_key_set(df: DataFrame, keys: DataFrame, on, key_rows: int | None = None) -> DataFrame:
    """Membership in a computed key set as a left-semi join. The
    key set is broadcast when its (checked) size allows, so the fact rows
    are not shuffled by the key."""
    from .lookups import sized
    return df.join(sized(keys, key_rows), on=on, how="left_semi")


def validate_requests(df: DataFrame) -> DataFrame:
    """Reasons a scoring request is out of range (empty array = valid)."""
    checks = []
    for name, lo, hi in C.REQUEST_RULES:
        c = F.col(name)
        checks.append(F.when(c.isNull() | (c < lo) | (c > hi), F.lit(f"{name} must be in [{lo}, {hi}]")))
    for name in ("origin_airport_code", "destination_airport_code", "airline_code"):
        c = F.col(name)
        checks.append(F.when(c.isNull() | (F.length(c) < 1), F.lit(f"{name} must not be empty")))
    d = F.col("distance")
    checks.append(F.when(d.isNull() | F.isnan(d) | (d < 0), F.lit("distance must be >= 0")))
    return df.withColumn("errors", F.filter(F.array(*checks), lambda x: x.isNotNull()))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid requests and the quarantine (rows kept, with reasons)."""
    v = validate_requests(df)
    return (v.filter(F.size("errors") == 0).drop("errors"), v.filter(F.size("errors") > 0))


def slot_completeness(df: DataFrame, fields=C.SLOT_FIELDS) -> DataFrame:
    """Missing-field list and completeness flag per row."""
    return (df.withColumn("missing", X.missing_fields(list(fields)))
              .withColumn("complete", F.size("missing") == 0))


def gate(df: DataFrame, fields=C.SLOT_FIELDS) -> DataFrame:
    """P12 + P14 in one pass: every row with its missing fields, whether it is
    complete, and the reason if it is not."""
    return slot_completeness(df, fields).withColumn(
        "reason", F.when(~F.col("complete"), F.concat(F.lit("missing: "), F.array_join("missing", ", "))))


def prediction_gate(df: DataFrame, fields=C.SLOT_FIELDS) -> tuple[DataFrame, DataFrame]:
    """Only complete rows go to scoring; the rest keep their reason."""
    s = slot_completeness(df, fields)
    return (s.filter("complete").drop("missing", "complete"),
            s.filter(~F.col("complete")).withColumn(
                "reason", F.concat(F.lit("missing: "), F.array_join("missing", ", "))))
