"""Vector search vs brute force; model and stream properties (R layer)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylag.operators import clean as P
from skylag.operators import encode as E
from skylag.operators import features as FE
from skylag.operators import model as MD
from skylag.operators import search as S
from skylag.session import shared_path
from skylag.sources import fixtures as FX
from skylag.sources.tables import read_table

SF001 = "/root/testdata/sf0.001"


def _bruteforce(ids, mat, k, metric):
    out = {}
    for i, q in zip(ids, mat):
        if metric == "l2":
            d = np.sqrt(((mat - q) ** 2).sum(1))
        else:
            d = 1 - (mat @ q) / (np.linalg.norm(mat, axis=1) * np.linalg.norm(q))
        order = np.lexsort((ids, d))[:k]
        out[int(i)] = [int(ids[j]) for j in order]
    return out


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_knn_matches_bruteforce_and_chunking(spark, metric):
    e = read_table(spark, SF001, "embeddings")
    pdf = e.toPandas()
    ids = pdf["vec_id"].to_numpy()
    mat = np.stack(pdf["embedding"].map(lambda v: np.asarray(v, dtype=np.float64)))
    exp = _bruteforce(ids, mat, 5, metric)
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    for maxq in (10_000, 128):          # one chunk, then several query chunks
        got = S.knn(q, e, k=5, metric=metric, max_queries=maxq).toPandas()
        res = {int(k): list(g.sort_values("rank")["match_id"]) for k, g in got.groupby("query_id")}
        assert res == exp


def test_resolve_names_exact_code_first(spark):
    ents = spark.createDataFrame([(1, "JFK", "john f kennedy"), (2, "LAX", "los angeles")],
                                 "entity_id int, code string, entity_name string")
    names = spark.createDataFrame([(1, "lax"), (2, "Los Angels"), (3, "kennedy john")], "name_id int, name string")
    out = {r["name_id"]: (r["code"], r["match"]) for r in S.resolve_names(names, ents, k=2).collect()}
    assert out[1] == ("LAX", "exact")
    assert out[2][0] == "LAX" and out[3][0] == "JFK"


@pytest.fixture(scope="module")
def quick_model(spark):
    p = FE.add_route_features(FE.preprocess_flights(FX.trips(spark, SF001)))
    tr, te = P.split_by_month(p)
    fm = E.fit_features(tr)
    m = MD.fit_two_stage(tr, fm, {"maxIter": 5, "maxDepth": 3, "stepSize": 0.1},
                         {"maxIter": 5, "maxDepth": 3, "stepSize": 0.1})
    return m, tr, te


def test_two_stage_outputs(quick_model):
    m, tr, te = quick_model
    out = m.transform(te).select("delay_probability", "delayed", "delay_minutes").toPandas()
    assert len(out) == te.count()
    assert out["delay_probability"].between(0, 1).all()
    assert ((out["delay_minutes"] == 0) | out["delayed"]).all()
    assert (out.loc[out["delayed"], "delay_minutes"] >= 0).all()


def test_save_load_same_scores(spark, quick_model):
    m, tr, te = quick_model
    path = shared_path(spark, "model-test")
    m.save(path)
    assert MD.model_status(spark, path).first()["model_loaded"]
    m2 = MD.TwoStageModel.load(spark, path)
    key = lambda r: tuple(str(x) for x in r)
    a = sorted(m.transform(te).select("flight_id", "delay_probability", "delay_minutes").collect(), key=key)
    b = sorted(m2.transform(te).select("flight_id", "delay_probability", "delay_minutes").collect(), key=key)
    assert a == b


def test_stream_equals_batch(spark, quick_model):
    from skylag.plans import catalog as CT
    from skylag.streaming.jobs import stream_scoring
    m, tr, te = quick_model
    req = CT.requests(spark, SF001)
    src = shared_path(spark, "st-test-src")
    req.repartition(3).write.parquet(src)
    out, ck = shared_path(spark, "st-test-out"), shared_path(spark, "st-test-ck")
    stream_scoring(spark, m, src, spark.read.parquet(src).schema, out, ck).awaitTermination()
    cols = ["flight_id", "delay_probability", "delayed", "delay_minutes", "error"]
    key = lambda r: tuple(str(x) for x in r)  # noqa: E731  (flight_id is not unique)
    batch = sorted(MD.score_requests(m, spark.read.parquet(src)).select(*cols).collect(), key=key)
    stream = sorted(spark.read.parquet(out).select(*cols).collect(), key=key)
    assert batch == stream


def test_session_stream_equals_batch(spark):
    from skylag.plans import catalog as CT
    from skylag.streaming import jobs as SJ
    a = SJ.st2_stream_slot_state(spark, SF001).orderBy("session_id").collect()
    b = CT.k1_w2_slot_state(spark, SF001).orderBy("session_id").collect()
    assert a == b


def test_mae_not_worse_than_constant(quick_model):
    m, tr, te = quick_model
    met = {(r["task"], r["metric"]): r["value"] for r in MD.evaluate_two_stage(m, te).collect()}
    assert ("classification", "roc_auc") in met and ("summary", "test_set_size") in met
    assert 0.0 <= met[("classification", "accuracy")] <= 1.0


def test_session_ttl_stream_matches_batch(spark):
    """Closed activity windows from the watermarked stream equal the batch
    computation over the same events (windows still open at the end of the
    input are not emitted yet, so compare on the closed ones)."""
    from skylag.plans.catalog import SLOTS
    from skylag.sources.tables import TABLE_SCHEMAS
    from skylag.streaming import jobs as SJ
    src = shared_path(spark, "ttl-src")
    ev = read_table(spark, SF001, "events")
    # arrival in time order: four files written one after the other
    cuts = ev.approxQuantile("event_id", [0.25, 0.5, 0.75], 0.0)
    bounds = [-1] + cuts + [float("inf")]
    for i in range(4):
        part = ev.filter((F.col("event_id") > bounds[i]) & (F.col("event_id") <= bounds[i + 1]))
        part.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(TABLE_SCHEMAS["events"]).option("maxFilesPerTrigger", 1).parquet(src)
    log = stream.select(F.col("user_id").alias("session_id"), "ts", F.col("event_id").alias("seq"),
                        F.col("event_type").alias("slot"), "value")
    out, ck = shared_path(spark, "ttl-out"), shared_path(spark, "ttl-ck")
    SJ.slot_state_stream_ttl(log, SLOTS, "6 hours", out, ck).awaitTermination()
    got = spark.read.parquet(out)
    blog = ev.select(F.col("user_id").alias("session_id"), "ts", F.col("event_id").alias("seq"),
                     F.col("event_type").alias("slot"), "value")
    batch = SJ.slot_state_by_activity(SJ.with_event_time(blog), SLOTS, "6 hours")
    key = lambda r: tuple(str(x) for x in r)
    cols = ["session_id", "active_from", "active_to", *SLOTS]
    g = sorted(got.select(*cols).collect(), key=key)
    b = {key(r) for r in batch.select(*cols).collect()}
    assert g and all(key(r) in b for r in g)


def test_knn_exact_under_ties(spark):
    """Duplicated vectors: every query sees many equal distances; the k
    nearest must be the k smallest ids among the ties."""
    from pyspark.sql import types as T
    rows = [(i, [float(i % 3), 1.0, 0.0]) for i in range(60)]          # 3 distinct vectors, 20 copies each
    schema = T.StructType([T.StructField("vec_id", T.LongType()),
                           T.StructField("embedding", T.ArrayType(T.FloatType()))])
    corpus = spark.createDataFrame(rows, schema).repartition(4)
    q = corpus.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    got = S.knn(q, corpus, k=5).toPandas()
    for qid, g in got.groupby("query_id"):
        same = sorted(i for i in range(60) if i % 3 == qid % 3)[:5]
        assert sorted(g["match_id"]) == same
        assert (g["distance"] == 0).all()


def test_train_job_on_csv_layout(spark):
    """S1 (CSV layout) + S7: flights.csv with the full column order, the two
    dimension files, then the whole training job with a tiny preset."""
    from jobs.train import run
    from skylag.sources.tables import FLIGHTS
    d = shared_path(spark, "csv-layout")
    t = FX.trips(spark, SF001)
    cols = [F.col(f.name).cast(f.dataType) if f.name in t.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in FLIGHTS.fields]
    t.select(*cols).coalesce(1).write.option("header", True).csv(f"{d}/flights.csv")
    FX.airports(spark, SF001).coalesce(1).write.option("header", True).csv(f"{d}/airports.csv")
    FX.airlines(spark, SF001).coalesce(1).write.option("header", True).csv(f"{d}/airlines.csv")
    tiny = {"maxIter": 3, "maxDepth": 2, "stepSize": 0.1}
    m = {(r["task"], r["metric"]): r["value"] for r in run(spark, d, shared_path(spark, "csv-out"), tiny, tiny,
                                                           layout="csv").collect()}
    assert m[("summary", "test_set_size")] > 0 and 0 <= m[("classification", "roc_auc")] <= 1


def test_spark_ml_pipeline_wrapper(spark):
    from pyspark.ml import Pipeline
    p = FE.add_route_features(FE.preprocess_flights(FX.trips(spark, SF001)))
    tr, te = P.split_by_month(p)
    tiny = {"maxIter": 3, "maxDepth": 2, "stepSize": 0.1}
    pm = Pipeline(stages=[MD.TwoStageDelayEstimator(tiny, tiny)]).fit(tr)
    a = pm.transform(te).select("flight_id", "delay_probability", "delay_minutes")
    path = shared_path(spark, "ml-wrapper")
    pm.stages[0].write().overwrite().save(path)
    b = MD.TwoStageDelayModel.load(path).transform(te).select("flight_id", "delay_probability", "delay_minutes")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(a.collect(), key=key) == sorted(b.collect(), key=key)


def test_model_learns_a_seeded_signal(spark):
    """Late iff DISTANCE >= 1500 (the classifier sees the distance class);
    late minutes grow with distance (the regressor sees raw distance). The
    classifier must separate it and the regressor must beat the constant
    baseline (catches misaligned feature columns or labels)."""
    t = FX.trips(spark, SF001)
    seeded = t.withColumn("ARRIVAL_DELAY", F.when(F.col("ARRIVAL_DELAY").isNull(), None)
                          .when(F.col("DISTANCE") >= 1500, 16 + F.col("DISTANCE") / 20).otherwise(-5.0))
    p = FE.add_route_features(FE.preprocess_flights(seeded))
    tr, te = P.split_by_month(p)
    params = {"maxIter": 10, "maxDepth": 4, "stepSize": 0.3}
    m = MD.fit_two_stage(tr, E.fit_features(tr), params, params)
    met = {(r["task"], r["metric"]): r["value"] for r in MD.evaluate_two_stage(m, te).collect()}
    assert met[("classification", "roc_auc")] > 0.95
    assert met[("regression", "mae")] < 0.5 * met[("regression", "baseline_mae")]


def test_scoring_jobs_cli(spark, quick_model):
    """jobs/score.py and jobs/stream_score.py on a saved model give the same rows."""
    from jobs import score, stream_score
    from skylag.plans import catalog as CT
    m, tr, te = quick_model
    base = shared_path(spark, "cli")
    MD.TwoStageDelayModel(m).write().save(f"{base}/out/model")
    CT.requests(spark, SF001).repartition(2).write.parquet(f"{base}/req")
    score.main(["--model-dir", f"{base}/out", "--requests", f"{base}/req", "--output", f"{base}/batch"])
    stream_score.main(["--model-dir", f"{base}/out", "--source", f"{base}/req", "--output", f"{base}/stream",
                       "--checkpoint", f"{base}/ck"])
    cols = ["flight_id", "delay_probability", "delayed", "delay_minutes", "error"]
    key = lambda r: tuple(str(x) for x in r)
    a = sorted(spark.read.parquet(f"{base}/batch").select(*cols).collect(), key=key)
    b = sorted(spark.read.parquet(f"{base}/stream").select(*cols).collect(), key=key)
    assert a == b and len(a) == 6000


def test_registered_queries_fit_the_reference_preset(spark, monkeypatch, tmp_path):
    """Every registered fit and search gets the published parameters."""
    import jobs.train
    from skylag import config as C
    from skylag.plans import modeling

    class Stop(Exception):
        pass

    def fit(tr, fm, cls_params, reg_params):
        fits.append((cls_params, reg_params))
        raise Stop

    def search(tr, fm, task, grid, algorithms, notes, note):
        searched.append((task, grid))
        raise Stop

    fits, searched = [], []
    monkeypatch.setattr(modeling, "_FITTED", {})
    spark.conf.set("skylag.fit.store", str(tmp_path))  # nothing fitted before
    monkeypatch.setattr(MD, "fit_two_stage", fit)
    monkeypatch.setattr(MD, "grid_search", search)
    for name in ("m1_m4_two_stage_predictions", "s7_train_job"):
        with pytest.raises(Stop):
            modeling.Q[name][0](spark, SF001)
    assert jobs.train.MD is MD and fits == [(C.CLASSIFIER_PARAMS, C.REGRESSOR_PARAMS)] * 2
    for name in ("m5_m6_t5_temporal_grid_search", "m5_regression_grid_search"):
        with pytest.raises(Stop):
            modeling.Q[name][0](spark, SF001)
    assert searched == [("classification", C.PARAM_GRID), ("regression", C.PARAM_GRID)]
    spark.conf.unset("skylag.fit.store")
