"""Fit-side aggregates (A1–A10, A19, A20) and the distributed prefix sum.

Nothing here gathers rows that grow with the data on the driver or in a
single task: group statistics use partial (map-side) aggregation, exact
quantiles and cumulative sums go through ``prefix_sums`` which splits the
ordered key space into range buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as X
from ..session import materialize

Y = "ARRIVAL_DELAY"


def late_rate(y=Y, threshold=C.DELAY_THRESHOLD) -> Column:
    """A3: share of rows with ``y > threshold``; null y counts as not late."""
    return F.avg(X.late_label(y, threshold).cast("double"))


def global_stats(df: DataFrame, y=Y, threshold=C.DELAY_THRESHOLD) -> DataFrame:
    """A1: one row (global_delay_mean, global_delay_rate)."""
    return df.agg(F.avg(y).alias("global_delay_mean"), late_rate(y, threshold).alias("global_delay_rate"))


def group_stats(df: DataFrame, keys, y=Y, threshold=C.DELAY_THRESHOLD, pct=False) -> DataFrame:
    """A2 + A3 + A5: mean, late rate and row count per key; null keys dropped
    (pandas groupby drops them)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    cond = None
    for k in keys:
        cond = F.col(k).isNotNull() if cond is None else cond & F.col(k).isNotNull()
    rate = late_rate(y, threshold) * (100.0 if pct else 1.0)
    return (df.filter(cond).groupBy(*keys)
              .agg(F.avg(y).alias("delay_mean"), rate.alias("delay_rate"),
                   F.count(F.lit(1)).alias("n")))


HIST_KEYS = ("ROUTE", "AIRLINE", "DEP_HOUR")


def historical_bundle(df: DataFrame, y=Y, threshold=C.DELAY_THRESHOLD, keys=HIST_KEYS) -> DataFrame:
    """A4: mean and late rate per route, airline, hour and overall in ONE
    aggregation pass (grouping sets), instead of seven group-bys.

    Output: ``level`` (key name or 'GLOBAL'), the key columns, n, mean, rate.
    Null keys are dropped per level, as pandas groupby does.
    """
    keys = list(keys)
    gs = df.groupingSets([[k] for k in keys] + [[]], *keys).agg(
        F.grouping_id().alias("_gid"),
        F.avg(y).alias("delay_mean"), late_rate(y, threshold).alias("delay_rate"),
        F.count(F.lit(1)).alias("n"))
    nk = len(keys)
    level = None
    for i, k in enumerate(keys):
        # grouping_id bit for key i is 0 when the key is grouped
        gid = (2 ** nk - 1) - 2 ** (nk - 1 - i)
        level = F.when(F.col("_gid") == gid, F.lit(k)) if level is None else level.when(F.col("_gid") == gid, F.lit(k))
    level = level.otherwise(F.lit("GLOBAL"))
    out = gs.withColumn("level", level).drop("_gid")
    keep = None
    for k in keys:
        c = (F.col("level") != k) | F.col(k).isNotNull()
        keep = c if keep is None else keep & c
    return out.filter(keep).select("level", *keys, "n", "delay_mean", "delay_rate")


def distinct_count(df: DataFrame, c, approx=False) -> DataFrame:
    """A6."""
    f = F.approx_count_distinct(c) if approx else F.count_distinct(c)
    return df.agg(f.alias(f"n_distinct_{c}"))


def _bucket_of(v, cuts) -> Column:
    """Number of cut points strictly below ``v`` (bisect-left), as a
    balanced tree of comparisons: log2(len(cuts)) deep and code-generated
    (a higher-order ``filter`` over the cut array would be interpreted)."""
    def rec(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.lit(cuts[mid]) < v, rec(mid + 1, hi)).otherwise(rec(lo, mid))
    return rec(0, len(cuts))


def default_buckets(df: DataFrame) -> int:
    """Range buckets for prefix sums: as many as the cluster's shuffle width
    (so the window stage runs with full parallelism), at least 64."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(C.PREFIX_BUCKETS, n)


def prefix_sums(df: DataFrame, order_col: str, sum_cols, descending=False, partition_cols=(),
                buckets: int | None = None, inclusive=True) -> DataFrame:
    """Cumulative sums along ``order_col`` without a one-partition window.

    ``df`` must hold one row per distinct (partition_cols, order_col). The
    ordered key space is cut into ``buckets`` ranges (default: the shuffle
    width, at least 64; cut points from one approximate-percentile pass: a
    list bounded by that setting). Bucket totals give each
    bucket's offset; the running sum inside a bucket is a window partitioned
    by (partition_cols, bucket), so no task sees more than its range.
    Adds ``cum_<c>``, the grand total ``tot_<c>`` (per partition group) and
    ``_bucket`` columns.
    """
    sum_cols = list(sum_cols)
    parts = list(partition_cols)
    v = F.col(order_col)
    buckets = default_buckets(df) if buckets is None else buckets
    if buckets > 1:
        # the input is an aggregate read twice (cut points, then sums): write
        # it once instead of recomputing its whole upstream plan
        df = materialize(df, "prefix-input")
        fr = [i / buckets for i in range(1, buckets)]
        row = df.agg(F.percentile_approx(v, fr, 10000)).first()
        cuts = sorted({c for c in (row[0] or []) if c is not None and c == c})
    else:
        cuts = []   # caller guarantees a bounded input (one range)
    order = v.desc() if descending else v.asc()
    if not cuts:
        # one range (bounded input): no offsets to add, no join needed
        w = (Window.partitionBy(*parts).orderBy(order)
             .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
        wall = Window.partitionBy(*parts)
        return df.select(*df.columns, F.lit(0).alias("_bucket"), *[
            F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"cum_{c}") for c in sum_cols], *[
            F.sum(c).over(wall).alias(f"tot_{c}") for c in sum_cols])
    # one binary search of comparisons, whatever the number of cut points: NaN is
    # above every number, infinities are ordinary values
    t = df.withColumn("_bucket", _bucket_of(v, cuts).cast("int"))
    if descending:
        t = t.withColumn("_bucket", F.lit(len(cuts)) - F.col("_bucket"))
    totals = t.groupBy(*parts, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    wo = Window.partitionBy(*parts).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    wall = Window.partitionBy(*parts)
    offs = totals.select(*parts, "_bucket", *[
        F.coalesce(F.sum(f"_t_{c}").over(wo), F.lit(0)).alias(f"_o_{c}") for c in sum_cols], *[
        F.sum(f"_t_{c}").over(wall).alias(f"tot_{c}") for c in sum_cols])
    # without partition columns the offsets table has at most `buckets` rows
    offs = F.broadcast(offs) if not parts else offs
    t = t.join(offs, [*parts, "_bucket"])
    w = (Window.partitionBy(*parts, "_bucket").orderBy(order)
         .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    return t.select(*df.columns, "_bucket", *[
        (F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in sum_cols],
        *[f"tot_{c}" for c in sum_cols])


BOUNDED_VALUES = 100_000


def exact_quantiles(df: DataFrame, c: str, probs, by=(), bounded: bool = False) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas/quantile_cont).

    Distributed and join-free: value counts -> prefix sums give each
    distinct value its inclusive cumulative count ``cum`` and the group
    total ``n``. The value at 0-based rank r is the smallest value with
    ``cum > r``, so every wanted rank is one ``min(when(cum > r, v))`` in a
    single (partially aggregated) group-by. Output: (*by, p, value).
    ``bounded=True`` is for inputs that should have few distinct values
    (e.g. one row per airport code): one range, no cut-point pass, if there
    are at most ``BOUNDED_VALUES``. Rows with a null value or group are left
    out; NaN is the largest value.
    """
    vc = value_counts(df, c, by)
    if bounded:  # a promise of the caller, checked: one range holds few values only
        vc = materialize(vc, "value-counts")
        bounded = vc.limit(BOUNDED_VALUES + 1).count() <= BOUNDED_VALUES
    return quantiles_of_counts(vc, c, probs, by, one_range=bounded)


def value_counts(df: DataFrame, c: str, by=()) -> DataFrame:
    """(*by, c, _cnt): how often each value occurs in each group, combined
    map-side. Null values and null groups are left out. Quantiles, whiskers
    and counts all follow from this table."""
    keep = F.col(c).isNotNull()
    for b in by:
        keep = keep & F.col(b).isNotNull()
    return df.filter(keep).groupBy(*by, c).agg(F.count(F.lit(1)).alias("_cnt"))


def quantiles_of_counts(vc: DataFrame, c: str, probs, by=(), one_range: bool = False) -> DataFrame:
    """``exact_quantiles`` from a table of ``value_counts``."""
    by = list(by)
    probs = [float(p) for p in probs]
    cum = prefix_sums(vc, c, ["_cnt"], partition_cols=by, buckets=1 if one_range else None)
    n, cm, v = F.col("tot__cnt"), F.col("cum__cnt"), F.col(c).cast("double")
    aggs = []
    for i, p in enumerate(probs):
        h = (n - 1) * F.lit(p)
        r0 = F.floor(h)
        r1 = F.least(r0 + 1, n - 1)
        aggs += [F.max(h).alias(f"_h{i}"), F.max(r0).alias(f"_r{i}"),
                 F.min(F.when(cm > r0, v)).alias(f"_a{i}"), F.min(F.when(cm > r1, v)).alias(f"_b{i}")]
    g = cum.groupBy(*by).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(p).alias("p"),
                              (F.col(f"_a{i}") + (F.col(f"_h{i}") - F.col(f"_r{i}")) * (F.col(f"_b{i}") - F.col(f"_a{i}")))
                              .alias("value")) for i, p in enumerate(probs)])
    return g.select(*by, F.inline(rows))


def airport_traffic(df: DataFrame, origin="ORIGIN_AIRPORT", dest="DESTINATION_AIRPORT") -> DataFrame:
    """J5 + A20: departures, arrivals and total per airport in one shuffle.

    A full outer join of two counts with fill 0 equals one aggregation over
    the union of (code, 1, 0) and (code, 0, 1) rows; the union form is a
    single exchange, and partial aggregation collapses hot airports map-side.
    """
    dep = df.select(F.col(origin).alias("airport"), F.lit(1).alias("d"), F.lit(0).alias("a"))
    arr = df.select(F.col(dest).alias("airport"), F.lit(0).alias("d"), F.lit(1).alias("a"))
    t = (dep.unionByName(arr).filter(F.col("airport").isNotNull()).groupBy("airport")
           .agg(F.sum("d").cast("long").alias("departures"), F.sum("a").cast("long").alias("arrivals")))
    return t.withColumn("total_movements", F.col("departures") + F.col("arrivals"))


def hub_airports(df: DataFrame, quantile=C.HUB_QUANTILE) -> DataFrame:
    """Airports whose traffic is >= the traffic quantile (one column)."""
    # one pass over the facts: the airport-level table is written once, then
    # the threshold, the filter and any size check read that small table
    traffic = materialize(airport_traffic(df), "airport-traffic")
    thr = hub_threshold(traffic, quantile)
    return (traffic.filter(F.col("total_movements") >= F.lit(thr))
                   .select(F.col("airport").alias("HUB_AIRPORT")))


def hub_threshold(traffic: DataFrame, quantile=C.HUB_QUANTILE) -> float:
    """The traffic quantile as a scalar (a one-row aggregate)."""
    # one row per airport code: the distinct traffic values are bounded
    row = exact_quantiles(traffic, "total_movements", [quantile], bounded=True).first()
    return float("inf") if row is None or row["value"] is None else float(row["value"])


def min_max_of(df: DataFrame, c: str) -> DataFrame:
    """A10: range of a group statistic (two-level aggregation)."""
    return df.agg(F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))
