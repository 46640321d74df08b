"""Property tests (Hypothesis) of the distributed algorithms against NumPy."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skylag.operators import metrics as M
from skylag.operators import stats as A

SETTINGS = settings(max_examples=8, deadline=None, derandomize=True)


@SETTINGS
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=300), st.sampled_from([1, 3, 16]))
def test_prefix_sums_equal_cumsum(spark, vals, buckets):
    keys = np.unique(np.array(vals, dtype=float))
    w = (np.abs(keys) % 7 + 1).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"v": keys, "w": w}))
    got = A.prefix_sums(df, "v", ["w"], buckets=buckets).toPandas().sort_values("v")
    assert (got["cum_w"].to_numpy() == np.cumsum(w)).all()
    assert (got["tot_w"].to_numpy() == w.sum()).all()


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-20, 20)), min_size=1, max_size=300),
       st.lists(st.floats(0, 1), min_size=1, max_size=4))
def test_exact_quantiles_equal_numpy(spark, rows, probs):
    pdf = pd.DataFrame(rows, columns=["g", "x"]).astype({"x": float})
    df = spark.createDataFrame(pdf)
    probs = sorted(set(round(p, 3) for p in probs))
    got = A.exact_quantiles(df, "x", probs, by=["g"]).toPandas()
    for r in got.itertuples():
        exp = np.quantile(pdf[pdf.g == r.g]["x"].to_numpy(), r.p)      # linear interpolation
        assert r.value == pytest.approx(exp, abs=1e-9)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 5)), min_size=2, max_size=300))
def test_roc_auc_equals_pairwise_count(spark, rows):
    y = np.array([r[0] for r in rows])
    s = np.array([r[1] for r in rows], dtype=float) / 5
    df = spark.createDataFrame(pd.DataFrame({"label": y, "score": s}))
    got = M.roc_auc(df).first()[0]
    pos, neg = s[y == 1], s[y == 0]
    if len(pos) == 0 or len(neg) == 0:
        assert got is None
    else:
        exp = sum((neg < p).sum() + 0.5 * (neg == p).sum() for p in pos) / (len(pos) * len(neg))
        assert got == pytest.approx(exp)


@SETTINGS
@given(st.lists(st.integers(-100, 250), min_size=1, max_size=300), st.sampled_from([5, 10, 100]))
def test_histogram_equals_numpy(spark, ys, bins):
    from skylag.operators import profile as PR
    y = np.array(ys, dtype=float)
    df = spark.createDataFrame(pd.DataFrame({"ARRIVAL_DELAY": y}))
    cnt, _ = np.histogram(np.clip(y, -60, 180), bins=bins)
    got = PR.histogram(df, bins=bins).toPandas()
    assert dict(zip(got["bin"], got["n"])) == {i: int(c) for i, c in enumerate(cnt) if c > 0}


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 9)), min_size=2, max_size=200))
def test_best_threshold_equals_bruteforce(spark, rows):
    y = np.array([r[0] for r in rows])
    s = np.array([r[1] for r in rows], dtype=float) / 10
    if y.sum() == 0:
        return
    df = spark.createDataFrame(pd.DataFrame({"label": y, "score": s}))
    best = M.best_f1_threshold(df).first()
    cands = []
    for t in sorted(set(s)):
        p = s >= t
        tp = (p & (y == 1)).sum()
        prec, rec = tp / p.sum(), tp / y.sum()
        cands.append((2 * prec * rec / (prec + rec + 1e-9), -t))
    f1, neg_t = max(cands)
    assert best["threshold"] == pytest.approx(-neg_t) and best["f1"] == pytest.approx(f1)
