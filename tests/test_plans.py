"""Plan-shape checks: the scale properties the design relies on."""

import re

import pytest

import __spark_entry__ as ent
from skylag.operators import clean as P
from skylag.operators import encode as E
from skylag.operators import stats as A
from skylag.plans import catalog as CT

SF001 = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_apply_never_shuffles_the_facts(spark):
    tr, te = P.split_by_month(CT.prepared(spark, SF001))
    fm = E.fit_features(tr)
    p = plan(fm.transform(te))
    assert p.count("BroadcastHashJoin") >= 5 + 3          # 5 lookups + the 3 source-side joins
    assert "SortMergeJoin" not in p and "ShuffledHashJoin" not in p


def test_grouping_sets_combine_map_side(spark):
    tr, _ = P.split_by_month(CT.prepared(spark, SF001))
    p = plan(A.historical_bundle(tr))
    assert p.count("Expand") == 1
    assert re.search(r"partial_avg", p) and p.index("partial_avg") > p.index("Exchange")   # partial below exchange


def test_prefix_sums_window_per_bucket(spark):
    df = spark.range(1000).selectExpr("cast(id as double) as v", "1L as w")
    p = plan(A.prefix_sums(df, "v", ["w"], buckets=8))
    assert "windowspecdefinition(_bucket" in p


def test_scan_reads_only_used_columns(spark):
    p = plan(CT.p1_clean_flights(spark, SF001))
    scan = [line for line in p.splitlines() if "FileScan parquet" in line and "lineitem" in line][0]
    for unused in ("l_extendedprice", "l_discount", "l_tax"):
        assert unused not in scan


@pytest.mark.parametrize("name", sorted(ent.oracle_sql()))
def test_no_cartesian_products(spark, name):
    p = plan(ent.queries()[name](spark, SF001))
    assert "CartesianProduct" not in p
    for line in p.splitlines():
        if "BroadcastNestedLoopJoin" in line:
            assert re.search(r"BroadcastNestedLoopJoin \w+, \w+, .+", line), line   # always with a condition
