"""Aggregates, distributed prefix sums, exact quantiles and metrics
against brute force (pandas / NumPy) on small frames (FIXTURES §5.3–5.4)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skylag.operators import metrics as M
from skylag.operators import stats as A


def test_prefix_sums_match_cumsum(spark):
    rng = np.random.default_rng(1)
    vals = np.unique(rng.integers(0, 10_000, 3000))
    w = rng.integers(1, 5, len(vals))
    df = spark.createDataFrame(pd.DataFrame({"v": vals.astype(float), "w": w}))
    got = A.prefix_sums(df, "v", ["w"], buckets=16).toPandas().sort_values("v")
    assert (got["cum_w"].to_numpy() == np.cumsum(w)).all()
    down = A.prefix_sums(df, "v", ["w"], descending=True, buckets=16, inclusive=False).toPandas().sort_values("v")
    expect = np.cumsum(w[::-1])[::-1] - w
    assert (down["cum_w"].to_numpy() == expect).all()


@pytest.mark.parametrize("bounded", [False, True])
def test_exact_quantiles_match_pandas(spark, bounded):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(10, 40, 5000))
    pdf = pd.DataFrame({"x": x, "g": rng.integers(0, 3, 5000)})
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.25, 0.5, 0.9, 0.95, 1.0]
    got = A.exact_quantiles(df, "x", probs, bounded=bounded).toPandas().set_index("p")["value"]
    for p in probs:
        assert got[p] == pytest.approx(pdf["x"].quantile(p), abs=1e-9)
    grouped = A.exact_quantiles(df, "x", [0.25, 0.75], by=["g"]).toPandas()
    for r in grouped.itertuples():
        assert r.value == pytest.approx(pdf[pdf.g == r.g]["x"].quantile(r.p), abs=1e-9)


def test_historical_bundle_matches_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"ROUTE": rng.choice(["A-B", "B-C", None], 2000), "AIRLINE": rng.choice(["X", "Y"], 2000),
                        "DEP_HOUR": rng.integers(0, 24, 2000), "ARRIVAL_DELAY": rng.integers(-30, 90, 2000).astype(float)})
    out = A.historical_bundle(spark.createDataFrame(pdf)).toPandas()
    r = out[out.level == "ROUTE"].set_index("ROUTE")
    exp = pdf.dropna(subset=["ROUTE"]).groupby("ROUTE")["ARRIVAL_DELAY"]
    assert set(r.index) == {"A-B", "B-C"}
    for k in r.index:
        assert r.loc[k, "delay_mean"] == pytest.approx(exp.get_group(k).mean())
        assert r.loc[k, "delay_rate"] == pytest.approx((exp.get_group(k) > 15).mean())
    g = out[out.level == "GLOBAL"].iloc[0]
    assert g["delay_mean"] == pytest.approx(pdf["ARRIVAL_DELAY"].mean())
    assert g["n"] == len(pdf)


def _auc_bruteforce(y, s):
    pos, neg = s[y == 1], s[y == 0]
    tot = 0.0
    for p in pos:
        tot += (neg < p).sum() + 0.5 * (neg == p).sum()
    return tot / (len(pos) * len(neg))


def test_roc_auc_exact_with_ties(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 800)
    s = np.round(rng.random(800) * 0.5 + 0.3 * y, 2)
    df = spark.createDataFrame(pd.DataFrame({"label": y, "score": s}))
    assert M.roc_auc(df).first()[0] == pytest.approx(_auc_bruteforce(y, s))


def test_auc_edge_cases(spark):
    one_class = spark.createDataFrame(pd.DataFrame({"label": [1, 1], "score": [0.2, 0.4]}))
    assert M.roc_auc(one_class).first()[0] is None
    equal = spark.createDataFrame(pd.DataFrame({"label": [0, 1, 0, 1], "score": [0.5] * 4}))
    assert M.roc_auc(equal).first()[0] == pytest.approx(0.5)


def test_best_threshold_and_zero_division(spark):
    y = np.array([0, 0, 1, 1, 1, 0])
    s = np.array([0.1, 0.4, 0.35, 0.8, 0.8, 0.2])
    df = spark.createDataFrame(pd.DataFrame({"label": y, "score": s}))
    best = M.best_f1_threshold(df).first()
    # brute force over distinct thresholds (predict score >= t)
    cands = []
    for t in sorted(set(s)):
        p = s >= t
        tp = (p & (y == 1)).sum()
        prec = tp / p.sum()
        rec = tp / (y == 1).sum()
        cands.append((2 * prec * rec / (prec + rec + 1e-9), -t, t))
    assert best["threshold"] == pytest.approx(max(cands)[2])
    m = M.classifier_metrics(df, threshold=0.99).first()   # zero predicted positives
    assert m["precision"] == 0.0 and m["recall"] == 0.0 and m["f1_score"] == 0.0


def test_regression_metrics(spark):
    y = np.array([20.0, 30.0, 60.0, 100.0])
    p = np.array([25.0, 28.0, 50.0, 120.0])
    df = spark.createDataFrame(pd.DataFrame({"y": y, "pred": p}))
    r = M.regression_metrics(df, baseline=40.0).first()
    e = p - y
    assert r["mae"] == pytest.approx(np.abs(e).mean())
    assert r["rmse"] == pytest.approx(np.sqrt((e ** 2).mean()))
    assert r["std_error"] == pytest.approx(np.std(e))
    assert r["r2"] == pytest.approx(1 - (e ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert r["baseline_mae"] == pytest.approx(np.abs(y - 40).mean())


def test_class_balance_no_positive(spark):
    df = spark.createDataFrame(pd.DataFrame({"label": [0, 0, 0]}))
    r = M.class_balance(df).first()
    assert r["n0"] == 3 and r["n1"] == 0 and r["imbalance_ratio"] is None


def test_airport_traffic_full_outer(spark):
    df = spark.createDataFrame(pd.DataFrame({"ORIGIN_AIRPORT": ["A", "A", "B"], "DESTINATION_AIRPORT": ["B", "C", "A"]}))
    t = {r["airport"]: (r["departures"], r["arrivals"]) for r in A.airport_traffic(df).collect()}
    assert t == {"A": (2, 1), "B": (1, 1), "C": (0, 1)}


def test_histogram_matches_numpy(spark):
    from skylag.operators import profile as PR
    rng = np.random.default_rng(7)
    y = np.concatenate([np.round(rng.normal(10, 50, 3000)), [-500.0, 400.0, 180.0, -60.0]])
    df = spark.createDataFrame(pd.DataFrame({"ARRIVAL_DELAY": y}))
    cnt, edges = np.histogram(np.clip(y, -60, 180), bins=100)
    got = PR.histogram(df).toPandas().sort_values("bin")
    assert dict(zip(got["bin"], got["n"])) == {i: int(c) for i, c in enumerate(cnt) if c > 0}
    assert np.allclose(got["left"].to_numpy(), edges[got["bin"].to_numpy()])


def test_missing_profile_half_even(spark):
    from skylag.operators import profile as PR
    # 1 missing of 800 rows = 0.125 % -> pandas .round(2) gives 0.12 (half to even)
    df = spark.createDataFrame([(None if i == 0 else 1.0,) for i in range(800)], "v double")
    assert PR.missing_profile(df).first()["missing_pct"] == 0.12


def test_prefix_sums_many_buckets(spark):
    """Past 256 cut points the bucket is found by a JVM binary search."""
    vals = np.arange(5000, dtype=float)
    w = (vals.astype(int) % 5 + 1)
    df = spark.createDataFrame(pd.DataFrame({"v": vals, "w": w}))
    for desc in (False, True):
        got = A.prefix_sums(df, "v", ["w"], buckets=600, descending=desc).toPandas().sort_values("v")
        exp = np.cumsum(w) if not desc else np.cumsum(w[::-1])[::-1]
        assert (got["cum_w"].to_numpy() == exp).all()
        assert got["_bucket"].nunique() > 256
