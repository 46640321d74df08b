"""Exploratory tables.

Each chart of the exploratory analysis becomes the table behind it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as X
from ..session import materialize
from .lookups import sized
from .stats import Y, late_rate, quantiles_of_counts, value_counts


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row as typed
    literals (the aggregate runs once as its own small job; no join)."""
    r = one_row.first()
    return df.withColumns({f.name: F.lit(r[f.name] if r is not None else None).cast(f.dataType)
                           for f in one_row.schema.fields})


def missing_profile(df: DataFrame) -> DataFrame:
    """Per column with nulls: count and percent (2 decimals, half-even
    like pandas), sorted by count desc (column name breaks ties). One
    aggregation pass."""
    n = F.count(F.lit(1))
    aggs = [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    wide = df.agg(n.alias("_rows"), *aggs)
    st = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing_count"))
                            for c in df.columns]))
    long = wide.select("_rows", st)
    return (long.filter(F.col("missing_count") > 0)
                .select("column", "missing_count",
                        F.bround(F.col("missing_count") * 100.0 / F.col("_rows"), 2).alias("missing_pct"))
                .orderBy(F.col("missing_count").desc(), "column"))


def correlation_matrix(df: DataFrame, cols, lower_only=True) -> DataFrame:
    """Pearson r for every column pair in ONE aggregation pass; as rows
    (col_a, col_b, r). ``lower_only`` keeps pairs i >= j (the unmasked
    triangle of the heat map)."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(len(cols)) if (i >= j or not lower_only)]
    aggs = [F.corr(F.col(cols[i]).cast("double"), F.col(cols[j]).cast("double")).alias(f"_r{i}_{j}")
            for i, j in pairs]
    wide = df.agg(*aggs)
    st = F.inline(F.array(*[F.struct(F.lit(cols[i]).alias("col_a"), F.lit(cols[j]).alias("col_b"),
                                     F.col(f"_r{i}_{j}").alias("r")) for i, j in pairs]))
    return wide.select(st)


def target_correlations(df: DataFrame, cols, target=Y) -> DataFrame:
    """r(target, c) for each c."""
    wide = df.agg(*[F.corr(F.col(target).cast("double"), F.col(c).cast("double")).alias(c) for c in cols])
    st = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in cols]))
    return wide.select(st)


def histogram(df: DataFrame, c=Y, bins=100, lo=-60.0, hi=180.0) -> DataFrame:
    """``bins`` equal-width bins over the range of the values clipped to
    [lo, hi] (edges from the data's min/max, as NumPy does); the last bin is
    closed. Bin indices follow NumPy: floor((x - first) * bins / span),
    then corrected against the edges ``first + i * span / bins`` so values
    within an ulp of an edge land where NumPy puts them."""
    x = X.clip(c, lo, hi)
    base = df.filter(F.col(c).isNotNull()).select(x.alias("_x"))
    r = base.agg(F.min("_x").alias("mn"), F.max("_x").alias("mx")).first()    # one-row aggregate
    if r is None or r["mn"] is None:
        return base.select(F.lit(0).alias("bin"), F.lit(0.0).alias("left"), F.lit(0.0).alias("right"),
                           F.lit(0).cast("long").alias("n")).limit(0)
    first, last = float(r["mn"]), float(r["mx"])
    if first == last:                        # NumPy widens a zero range by 0.5 on each side
        first, last = first - 0.5, last + 0.5
    step = (last - first) / bins
    norm = bins / (last - first)

    def edge(i):
        return F.when(i >= bins, F.lit(last)).otherwise(F.lit(first) + i * F.lit(step))
    xi = F.col("_x")
    i0 = F.least(F.floor((xi - F.lit(first)) * F.lit(norm)).cast("int"), F.lit(bins - 1))
    i1 = F.when(xi < edge(i0), i0 - 1).otherwise(i0)
    i2 = F.when((i1 != bins - 1) & (xi >= edge(i1 + 1)), i1 + 1).otherwise(i1)
    return (base.groupBy(i2.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
                .select("bin", edge(F.col("bin")).alias("left"), edge(F.col("bin") + 1).alias("right"), "n"))


def box_summary(df: DataFrame, c=Y, by=()) -> DataFrame:
    """Quartiles, 1.5·IQR whiskers (most extreme data inside the
    fences) and outlier count, per group. The rows are read once: all figures
    come from the table of value counts."""
    by = list(by)
    vc = materialize(value_counts(df, c, by), "box-counts")
    q = quantiles_of_counts(vc, c, [0.25, 0.5, 0.75], by)
    qw = q.groupBy(*by).agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n)
                              for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    qw = qw.withColumns({"_lf": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
                         "_uf": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
    if by:
        # one row per group: written once, then broadcast if its size allows
        qw = materialize(qw, "box-quartiles")
        j = vc.join(sized(qw), by)
    else:
        j = attach_row(vc, qw)
    x = F.col(c)
    inside = (x >= F.col("_lf")) & (x <= F.col("_uf"))
    return j.groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("_cnt"))).alias("outliers"), F.sum("_cnt").alias("n"))


def delay_class_counts(df: DataFrame, y=Y) -> DataFrame:
    """A14."""
    return (df.groupBy(X.delay_class(y).alias("delay_class")).agg(F.count(F.lit(1)).alias("n"))
              .filter(F.col("delay_class").isNotNull()))


def named_stats(df: DataFrame, keys, y=Y, threshold=C.DELAY_THRESHOLD) -> DataFrame:
    """mean_delay, delay_rate (percent) and count per key."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(F.avg(y).alias("mean_delay"),
                                 (late_rate(y, threshold) * 100).alias("delay_rate"),
                                 F.count(y).alias("count"))


def hub_combo_rates(df: DataFrame, y=Y, threshold=C.DELAY_THRESHOLD) -> DataFrame:
    """Late % for the four origin/destination hub combinations plus
    each rate's position against the unweighted mean of the four (W1)."""
    g = df.groupBy("IS_ORIGIN_HUB", "IS_DEST_HUB").agg((late_rate(y, threshold) * 100).alias("delay_rate"))
    g = materialize(g.withColumn("combo", X.hub_combo_label()), "hub-combos")   # read twice below
    m = g.agg(F.avg("delay_rate").alias("mean_of_combos"))
    return attach_row(g, m).withColumn("above_mean", F.col("delay_rate") > F.col("mean_of_combos"))


def overall_late_pct(df: DataFrame, y=Y, threshold=C.DELAY_THRESHOLD) -> DataFrame:
    """A17."""
    return df.agg((late_rate(y, threshold) * 100).alias("pct_delayed"))


def above_group_mean(stats: DataFrame, value: str) -> DataFrame:
    """Flag groups above the unweighted mean of the group values. The
    group mean is a one-row aggregate attached by a broadcast join, so no
    single task has to hold all groups."""
    stats = materialize(stats, "group-stats")      # one pass over the facts; read twice below
    m = stats.agg(F.avg(value).alias("mean_of_groups"))
    return attach_row(stats, m).withColumn("above_mean", F.col(value) > F.col("mean_of_groups"))


def top_routes(df: DataFrame, n=C.TOP_ROUTES) -> DataFrame:
    """N most frequent routes (route name breaks ties)."""
    return (df.filter(F.col("ROUTE").isNotNull()).groupBy("ROUTE").agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.col("n").desc(), "ROUTE").limit(n))


def best_worst_routes(df: DataFrame, y=Y, support=C.MIN_ROUTE_SUPPORT, k=C.BEST_WORST_N) -> DataFrame:
    """P10 + T2 + U1: routes with >= ``support`` flights; the k lowest and
    k highest mean delays, as one table tagged best/worst. The aggregate
    is shared by both top-k branches (ties broken by route)."""
    rs = (df.filter(F.col("ROUTE").isNotNull()).groupBy("ROUTE")
            .agg(F.avg(y).alias("mean_delay"), F.count(y).alias("count"))
            .filter(F.col("count") >= support))
    best = rs.orderBy(F.col("mean_delay").asc(), "ROUTE").limit(k).withColumn("side", F.lit("best"))
    worst = rs.orderBy(F.col("mean_delay").desc(), "ROUTE").limit(k).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def row_funnel(raw: DataFrame, train=C.TRAIN_MONTHS, test=C.TEST_MONTHS, y=Y,
               threshold=C.DELAY_THRESHOLD) -> DataFrame:
    """Raw -> cleaned -> train / test -> late counts in one pass."""
    clean = ((F.col("CANCELLED") == 0) & (F.col("DIVERTED") == 0) & F.col(y).isNotNull()
             & F.col("SCHEDULED_DEPARTURE").isNotNull() & F.col("TAIL_NUMBER").isNotNull())
    tr, te = F.col("MONTH").isin(list(train)), F.col("MONTH").isin(list(test))
    late = F.col(y) > threshold
    return raw.agg(
        F.count(F.lit(1)).alias("rows_raw"), F.count_if(clean).alias("rows_clean"),
        F.count_if(clean & tr).alias("rows_train"), F.count_if(clean & te).alias("rows_test"),
        F.count_if(clean & tr & late).alias("late_train"), F.count_if(clean & te & late).alias("late_test"))


def traffic_table(traffic: DataFrame) -> DataFrame:
    """Airport movements sorted by total (code breaks ties)."""
    return traffic.orderBy(F.col("total_movements").desc(), "airport")
