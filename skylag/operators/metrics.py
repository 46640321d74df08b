"""Exact distributed evaluation metrics.

Inputs are frames of (label 0/1, score double) or (truth, prediction).
Threshold-free metrics first collapse rows to one row per distinct score
(partial aggregation), then use the bucketed prefix sum — no global sort
into one partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from .stats import prefix_sums


def _div(a, b):
    """Zero division -> 0 (ANSI mode would raise on plain ``/``)."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df: DataFrame, label="label", pred="pred") -> DataFrame:
    """One row tn, fp, fn, tp."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    return df.agg(F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"),
                  F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"))


def classifier_metrics(df: DataFrame, label="label", score="score", threshold=0.5) -> DataFrame:
    """Accuracy, precision, recall, F1 at a threshold (zero division -> 0)."""
    pred = (F.col(score) >= F.lit(float(threshold))).cast("int")
    cm = confusion(df.withColumn("_pred", pred), label, "_pred")
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    precision, recall = _div(tp, tp + fp), _div(tp, tp + fn)
    return cm.select(
        "tn", "fp", "fn", "tp",
        _div(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        precision.alias("precision"), recall.alias("recall"),
        _div(2 * precision * recall, precision + recall).alias("f1_score"))


def class_report(df: DataFrame, label="label", score="score", threshold=0.5,
                 names=("On-time", "Delayed")) -> DataFrame:
    """Per-class precision/recall/F1/support plus macro and weighted
    averages, as rows (cls, precision, recall, f1_score, support)."""
    pred = (F.col(score) >= F.lit(float(threshold))).cast("int")
    cm = confusion(df.withColumn("_pred", pred), label, "_pred")
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    p1, r1 = _div(tp, tp + fp), _div(tp, tp + fn)
    p0, r0 = _div(tn, tn + fn), _div(tn, tn + fp)
    f1, f0 = _div(2 * p1 * r1, p1 + r1), _div(2 * p0 * r0, p0 + r0)
    s0, s1 = tn + fp, tp + fn
    tot = s0 + s1
    rows = F.array(
        F.struct(F.lit(names[0]).alias("cls"), p0.alias("precision"), r0.alias("recall"), f0.alias("f1_score"), s0.alias("support")),
        F.struct(F.lit(names[1]).alias("cls"), p1.alias("precision"), r1.alias("recall"), f1.alias("f1_score"), s1.alias("support")),
        F.struct(F.lit("macro avg").alias("cls"), ((p0 + p1) / 2).alias("precision"), ((r0 + r1) / 2).alias("recall"),
                 ((f0 + f1) / 2).alias("f1_score"), tot.alias("support")),
        F.struct(F.lit("weighted avg").alias("cls"), _div(p0 * s0 + p1 * s1, tot).alias("precision"),
                 _div(r0 * s0 + r1 * s1, tot).alias("recall"), _div(f0 * s0 + f1 * s1, tot).alias("f1_score"),
                 tot.alias("support")))
    return cm.select(F.inline(rows))


def score_counts(df: DataFrame, label="label", score="score") -> DataFrame:
    """Per distinct score: positives and negatives (map-side combined)."""
    return (df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("score"))
              .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")))


def roc_auc(df: DataFrame, label="label", score="score") -> DataFrame:
    """Exact ROC-AUC with ties counted one half.

    AUC = sum_s pos_s * (neg_below_s + neg_s / 2) / (P * N); neg_below_s is
    an exclusive prefix sum in ascending score order. Null when one class
    is absent."""
    sc = score_counts(df, label, score)
    cum = prefix_sums(sc, "score", ["neg"], inclusive=False)
    return cum.agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("cum_neg") + F.col("neg") / 2.0)),
                     F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("roc_auc"))


def pr_curve(df: DataFrame, label="label", score="score") -> DataFrame:
    """Precision and recall at every distinct score used as threshold
    (predict positive when score >= threshold)."""
    sc = score_counts(df, label, score)
    cum = prefix_sums(sc, "score", ["pos", "neg"], descending=True)   # tot_pos = all positives
    tp, fp = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    return cum.select(F.col("score").alias("threshold"), F.col("cum_pos").alias("tp"),
                      F.col("cum_neg").alias("fp"),
                      _div(tp, tp + fp).alias("precision"), _div(tp, F.col("tot_pos").cast("double")).alias("recall"))


def best_f1_threshold(df: DataFrame, label="label", score="score") -> DataFrame:
    """Threshold maximising F1 = 2PR / (P + R + 1e-9); ties -> the
    lowest threshold. ``orderBy(...).limit(1)`` plans as a per-partition
    top-1 (TakeOrderedAndProject), not a global sort."""
    pr = pr_curve(df, label, score)
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + C.F1_EPS)
    return (pr.withColumn("f1", f1).orderBy(F.col("f1").desc(), F.col("threshold").asc()).limit(1)
              .select("threshold", "precision", "recall", "f1"))


def regression_metrics(df: DataFrame, truth="y", pred="pred", baseline=None) -> DataFrame:
    """A27 (+A28 when ``baseline`` is given): MAE, RMSE, R², mean error,
    population std of the error, baseline MAE and improvement."""
    y, p = F.col(truth).cast("double"), F.col(pred).cast("double")
    e = p - y
    # SST = n * var_pop(y): Spark's variance merges partial moments stably,
    # unlike sum(y^2) - sum(y)^2 / n, which cancels badly on huge inputs
    aggs = [F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
            F.avg(e * e).alias("_mse"), F.var_pop(y).alias("_vy"),
            F.avg(e).alias("mean_error"), F.stddev_pop(e).alias("std_error")]
    if baseline is not None:
        b = baseline if not isinstance(baseline, (int, float)) else F.lit(float(baseline))
        aggs.append(F.avg(F.abs(y - b)).alias("baseline_mae"))
    m = df.agg(*aggs)
    out = m.withColumn("r2", 1 - F.try_divide(F.col("_mse"), F.col("_vy")))
    if baseline is not None:
        out = out.withColumn("mae_improvement", F.col("baseline_mae") - F.col("mae"))
    return out.drop("_mse", "_vy")


def class_balance(df: DataFrame, label="label") -> DataFrame:
    """Class counts and imbalance ratio n0 / n1 (null when n1 = 0)."""
    return df.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")) \
             .withColumn("imbalance_ratio", F.try_divide(F.col("n0").cast("double"), F.col("n1").cast("double")))


def metrics_table(parts: dict) -> DataFrame:
    """One-row metric frames -> long (task, metric, value double).
    ``parts`` maps a task name to one frame or a list of frames."""
    out = None
    for task, frames in parts.items():
        for frame in (frames if isinstance(frames, (list, tuple)) else [frames]):
            cols = [c for c, t in frame.dtypes if t in ("double", "float", "int", "bigint", "smallint")]
            st = F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                                    for c in cols]))
            long = frame.select(F.lit(task).alias("task"), st)
            out = long if out is None else out.unionByName(long)
    return out


CORE_METRICS = {"classification": ["accuracy", "precision", "recall", "f1_score", "roc_auc"],
                "regression": ["mae", "rmse", "r2"]}


def core_metrics(metrics: DataFrame) -> DataFrame:
    """The API subset; absent metrics default to 0.0."""
    spark = metrics.sparkSession
    want = spark.createDataFrame([(t, m) for t, ms in CORE_METRICS.items() for m in ms], "task string, metric string")
    return (want.join(metrics, ["task", "metric"], "left")
                .select("task", "metric", F.coalesce("value", F.lit(0.0)).alias("value")))
