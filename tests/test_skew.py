"""A key holding a third of all rows: aggregation combines it map-side and
the non-broadcast lookup path is split by AQE's skew join; results stay
whole and exact."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from skylag.operators import lookups as J
from skylag.operators import stats as A
from skylag.session import materialize
from skylag.sources import fixtures as FX

SF01 = "/root/testdata/sf0.01"


@pytest.fixture()
def skew_conf(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _skewed(spark):
    t = FX.trips(spark, SF01).withColumn("ROUTE", F.concat("ORIGIN_AIRPORT", F.lit("-"), "DESTINATION_AIRPORT"))
    hot = t.limit(30000).withColumn("ROUTE", F.lit("N01-N02"))     # + 30k rows on one route: > 1/3 of 90k
    return t.unionByName(hot)


def test_hot_key_lookup_beyond_broadcast_limit(spark, skew_conf):
    fact = _skewed(spark)
    # fitted tables are written to the shared folder, as fit_features does
    stats = materialize(A.group_stats(fact, "ROUTE").select("ROUTE", "delay_mean"), "skew-stats")
    # rows above the broadcast limit -> shuffle join; AQE must split the hot partition
    out = J.lookup_with_fallback(fact, stats, "ROUTE", {"delay_mean": ("ROUTE_DELAY_MEAN", -1.0)},
                                 rows=10 ** 12)
    qe = out._jdf.queryExecution()
    n = qe.toRdd().count()
    plan = qe.executedPlan().toString()
    assert n == fact.count()
    join = [line for line in plan.splitlines() if "SortMergeJoin" in line and "_k" in line]
    assert join and any("skew=true" in line for line in join), join
    pdf = fact.select("ROUTE", "ARRIVAL_DELAY").toPandas()
    exp = pdf.groupby("ROUTE")["ARRIVAL_DELAY"].mean()
    got = out.select("ROUTE", "ROUTE_DELAY_MEAN").distinct().toPandas().set_index("ROUTE")["ROUTE_DELAY_MEAN"]
    for k, v in exp.items():
        assert got[k] == pytest.approx(v)


def test_hot_key_aggregation_combines_map_side(spark):
    fact = _skewed(spark)
    g = A.group_stats(fact, "ROUTE")
    plan = g._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_avg") > plan.index("Exchange")
    hot = g.filter(F.col("ROUTE") == "N01-N02").first()
    assert hot["n"] >= 30000
