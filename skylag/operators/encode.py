"""Fit-on-train / apply-anywhere feature encoding.

``fit_features(train)`` computes every statistic from the training rows
only and writes it to the shared folder (typed Parquet tables, so an hour
key stays an int after a reload). ``FeatureModel.transform(df)`` applies
them to any frame of the flights schema — training rows, hold-out rows, a
scoring batch or a stream — with the same code.

One grouping-sets pass yields route/airline/hour means and late rates plus
the origin/destination target means; ROUTE_TE and AIRLINE_TE equal the
route and airline means (same rows, same fallback), so they are reused
instead of recomputed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter

from .. import config as C
from ..session import materialize
from .features import add_route_features
from .lookups import lookup_with_fallback
from .stats import exact_quantiles, historical_bundle

STAT_KEYS = ("ROUTE", "AIRLINE", "DEP_HOUR", "ORIGIN_AIRPORT", "DESTINATION_AIRPORT")


@dataclass
class FeatureModel:
    """Fitted state of the feature chain."""
    stats: DataFrame                 # long table from historical_bundle
    airports: DataFrame              # airport -> IS_HUB, ORIGIN_TE, DEST_TE
    global_mean: float | None
    global_rate: float | None
    hub_threshold: float
    vocab: dict = field(default_factory=dict)   # one-hot vocabularies (train, sorted)
    rows: dict = field(default_factory=dict)    # row counts of the lookup tables

    # -- lookup tables --------------------------------------------------------
    def level(self, name: str) -> DataFrame:
        return self.stats.filter(F.col("level") == name)

    def transform(self, df: DataFrame) -> DataFrame:
        """E8/E9 apply side: route features, hub flags, historical rates and
        means, target encodings. Unseen or null keys fall back to the global
        train values."""
        gm, gr = self.global_mean, self.global_rate
        if "ROUTE" not in df.columns:
            df = add_route_features(df)
        r = self.level("ROUTE").select("ROUTE", "delay_mean", "delay_rate")
        df = lookup_with_fallback(df, r, "ROUTE", {
            "delay_mean": ("ROUTE_DELAY_MEAN", gm), "delay_rate": ("ROUTE_DELAY_RATE_15", gr)},
            rows=self.rows.get("ROUTE"))
        a = self.level("AIRLINE").select("AIRLINE", "delay_mean", "delay_rate")
        df = lookup_with_fallback(df, a, "AIRLINE", {
            "delay_mean": ("AIRLINE_DELAY_MEAN", gm), "delay_rate": ("AIRLINE_DELAY_RATE_15", gr)},
            rows=self.rows.get("AIRLINE"))
        h = self.level("DEP_HOUR").select("DEP_HOUR", "delay_mean", "delay_rate")
        df = lookup_with_fallback(df, h, "DEP_HOUR", {
            "delay_mean": ("HOUR_DELAY_MEAN", gm), "delay_rate": ("HOUR_DELAY_RATE_15", gr)},
            rows=self.rows.get("DEP_HOUR"))
        ap = self.airports
        n = self.rows.get("AIRPORTS")
        df = lookup_with_fallback(df, ap, "airport", {
            "is_hub": ("IS_ORIGIN_HUB", 0), "origin_te": ("ORIGIN_AIRPORT_TE", gm)},
            rows=n, df_key="ORIGIN_AIRPORT")
        df = lookup_with_fallback(df, ap, "airport", {
            "is_hub": ("IS_DEST_HUB", 0), "dest_te": ("DESTINATION_AIRPORT_TE", gm)},
            rows=n, df_key="DESTINATION_AIRPORT")
        return df.withColumns({"ROUTE_TE": F.col("ROUTE_DELAY_MEAN"), "AIRLINE_TE": F.col("AIRLINE_DELAY_MEAN")})

    # -- persistence (S3/S4) ---------------------------------------------------
    def save(self, path: str) -> None:
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")
        self.airports.write.mode("overwrite").parquet(f"{path}/airports")
        meta = {"global_mean": self.global_mean, "global_rate": self.global_rate,
                "hub_threshold": self.hub_threshold, "vocab": self.vocab, "rows": self.rows}
        spark = self.stats.sparkSession
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
             .write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FeatureModel":
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        return FeatureModel(stats=spark.read.parquet(f"{path}/stats"),
                            airports=spark.read.parquet(f"{path}/airports"),
                            global_mean=meta["global_mean"], global_rate=meta["global_rate"],
                            hub_threshold=meta["hub_threshold"], vocab=meta["vocab"], rows=meta["rows"])


def one_hot_vocab(train: DataFrame, cols=C.CAT_LOW_CLS) -> dict:
    """E1 fit: sorted train categories per column. Only used for columns
    whose domain is fixed by a ``when`` chain (<= 4 labels), so the
    collected list is bounded."""
    out = {}
    for c in cols:
        vals = [r[0] for r in train.select(c).where(F.col(c).isNotNull()).distinct().collect()]
        out[c] = sorted(vals)
    return out


def fit_features(train: DataFrame, quantile=C.HUB_QUANTILE, cat_low=C.CAT_LOW_CLS) -> FeatureModel:
    """E8 fit side: all statistics from the training rows only, in ONE pass.

    A single grouping-sets aggregation over the training rows yields: the
    route/airline/hour means and late rates (J3), the origin/destination
    target means (E3), departures and arrivals per airport (the row counts
    of the origin/destination levels, J5) and the one-hot vocabularies (the
    keys of the low-cardinality levels, E1). It is written once to the
    shared folder; everything else is derived from that small table.
    """
    if "ROUTE" not in train.columns:
        train = add_route_features(train)
    keys = list(STAT_KEYS) + [c for c in cat_low if c not in STAT_KEYS]
    stats = materialize(historical_bundle(train, keys=keys), "feature-stats")
    # one small job: per level its row count, the global values and the
    # low-cardinality vocabularies (one row per level, <= 10 rows)
    vocab_cols = [c for c in cat_low]
    summary = stats.groupBy("level").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.max(F.when(F.col("level") == "GLOBAL", F.col("delay_mean"))).alias("gm"),
        F.max(F.when(F.col("level") == "GLOBAL", F.col("delay_rate"))).alias("gr"),
        *([F.collect_set(F.when(F.col("level").isin(vocab_cols),
                                F.coalesce(*[F.col(c).cast("string") for c in vocab_cols]))).alias("vals")]
          if vocab_cols else [F.array().alias("vals")])).collect()
    counts = {r["level"]: r["cnt"] for r in summary}
    g = next((r for r in summary if r["level"] == "GLOBAL"), None)
    # empty training input: the global values are missing (pandas gives NaN), not 0
    gm = float(g["gm"]) if g is not None and g["gm"] is not None else None
    gr = float(g["gr"]) if g is not None and g["gr"] is not None else None
    o = stats.filter(F.col("level") == "ORIGIN_AIRPORT").select(
        F.col("ORIGIN_AIRPORT").alias("airport"), F.col("delay_mean").alias("origin_te"),
        F.col("n").alias("departures"))
    d = stats.filter(F.col("level") == "DESTINATION_AIRPORT").select(
        F.col("DESTINATION_AIRPORT").alias("airport"), F.col("delay_mean").alias("dest_te"),
        F.col("n").alias("arrivals"))
    # Full outer alignment of the two counts, missing = 0 (airport-sized tables)
    traffic = o.join(d, "airport", "full_outer").withColumn(
        "total_movements", F.coalesce("departures", F.lit(0)) + F.coalesce("arrivals", F.lit(0)))
    # airport-level table (IATA codes): bounded, so one range suffices
    q = exact_quantiles(traffic, "total_movements", [quantile], bounded=True).first()
    thr = float(q["value"]) if q and q["value"] is not None else float("inf")
    airports = materialize(traffic.select(
        "airport", (F.col("total_movements") >= F.lit(thr)).cast("int").alias("is_hub"), "origin_te", "dest_te"),
        "feature-airports")
    rows = dict(counts)
    # upper bound of the airport table (origins + destinations): enough for the broadcast check
    rows["AIRPORTS"] = counts.get("ORIGIN_AIRPORT", 0) + counts.get("DESTINATION_AIRPORT", 0)
    vocab = {c: sorted(next((r["vals"] for r in summary if r["level"] == c), [])) for c in cat_low}
    stats = stats.filter(~F.col("level").isin([c for c in cat_low if c not in STAT_KEYS]))
    return FeatureModel(stats=stats, airports=airports, global_mean=gm, global_rate=gr,
                        hub_threshold=thr, vocab=vocab, rows=rows)


def one_hot(df: DataFrame, vocab: dict) -> DataFrame:
    """E1/E2 apply: drop-first dummies from the TRAIN vocabulary on any
    frame (null or unseen -> all zeros)."""
    out = {}
    for c, cats in vocab.items():
        for cat in cats[1:]:
            out[f"{c}_{cat}"] = F.coalesce(F.col(c) == F.lit(cat), F.lit(False)).cast("int")
    return df.withColumns(out) if out else df


def matrix_columns(features, cat_low, cat_high, vocab) -> list[str]:
    """Column order of the encoded matrix: originals minus encoded columns,
    then dummies (per column, in vocabulary order), then ``<col>_TE``."""
    cols = list(features)
    for c in cat_low:
        if c in cols:
            cols.remove(c)
            cols += [f"{c}_{cat}" for cat in vocab.get(c, [])[1:]]
    for c in cat_high:
        if c in cols:
            cols.append(f"{c}_TE")
            cols.remove(c)
    return cols


def classification_matrix(df: DataFrame, fm: FeatureModel, features=C.FEATURES_CLS,
                          cat_low=C.CAT_LOW_CLS, cat_high=C.CAT_HIGH, keep=("ARRIVAL_DELAY", "MONTH")) -> DataFrame:
    """E5: encoded classification columns (+ target and month)."""
    cols = matrix_columns(features, cat_low, cat_high, fm.vocab)
    enc = one_hot(df, {c: fm.vocab.get(c, []) for c in cat_low})
    return enc.select(*cols, *[k for k in keep if k in df.columns])


def regression_matrix(df: DataFrame, fm: FeatureModel, features=C.FEATURES_REG,
                      cat_low=C.CAT_LOW_REG, cat_high=C.CAT_HIGH, keep=("ARRIVAL_DELAY", "MONTH")) -> DataFrame:
    """E6."""
    cols = matrix_columns(features, cat_low, cat_high, fm.vocab)
    enc = one_hot(df, {c: fm.vocab.get(c, []) for c in cat_low}) if cat_low else df
    return enc.select(*cols, *[k for k in keep if k in df.columns])


def assemble(df: DataFrame, cols, out="features") -> DataFrame:
    """Numeric columns -> one vector column (nulls imputed as 0.0: Spark
    trees have no native missing-value branch)."""
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(filled)


# -- Spark ML wrappers (E8): the feature chain as an Estimator / Model --------------

class DelayFeatureEstimator(Estimator):
    """``fit(train)``: every feature statistic from the training rows only."""

    def __init__(self, quantile: float = C.HUB_QUANTILE):
        super().__init__()
        self.quantile = quantile

    def _fit(self, dataset: DataFrame) -> "DelayFeatureModel":
        return DelayFeatureModel(fit_features(dataset, quantile=self.quantile))


class _FeatureWriter(MLWriter):
    def __init__(self, instance: "DelayFeatureModel"):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        self.instance.inner.save(path)


class _FeatureReader(MLReader):
    def load(self, path: str) -> "DelayFeatureModel":
        return DelayFeatureModel(FeatureModel.load(SparkSession.getActiveSession(), path))


class DelayFeatureModel(Model, MLWritable, MLReadable):
    """Applies the fitted statistics to any flights frame (batch or stream)."""

    def __init__(self, inner: FeatureModel | None = None):
        super().__init__()
        self.inner = inner

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.inner.transform(dataset)

    def write(self) -> MLWriter:
        return _FeatureWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _FeatureReader()
