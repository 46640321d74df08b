"""Message log, sinks and sources of the third round."""

import json

import pytest
from pyspark.sql import functions as F

from skylag import config as C
from skylag.operators import sessions as K
from skylag.session import shared_path
from skylag.sources import tables as TB
from skylag.streaming import jobs as SJ


def log(spark, rows):
    return spark.createDataFrame([(s, i, i, k, t, b if isinstance(b, str) or b is None else json.dumps(b)) for i, (s, k, t, b) in enumerate(rows)],
                                 "session_id long, ts int, seq int, kind string, tool string, body string")


def test_message_status_of_every_branch(spark):
    full = {"month": 1, "day_of_week": 2, "scheduled_departure_hour": 0, "scheduled_arrival_hour": 23, "origin_airport_code": "A",
            "destination_airport_code": "B", "airline_code": "X", "distance": 0.0}
    got = {r.session_id: r for r in K.status_from_messages(log(spark, [
        (1, "call", "call_predict_api", full), (1, "result", None, {"delay_probability": 0.125}),
        (2, "call", "update_flight_slots", {**full, "month": None}), (2, "call", "search_airports", {"month": 9}),
        (3, "call", "update_flight_slots", full), (3, "call", "calculate_distance", {"origin_airport_code": "", "destination_airport_code": "C", "month": 7}),
        (4, "user", None, "hello"), (4, "result", None, '{"distance_miles": '), (4, "result", None, None),
    ])).collect()}
    assert got[1].complete and got[1].reason is None and got[1].reply == "Prediction complete: delay probability 12.5%."
    assert tuple(got[1].last_prediction) == (0.125, False, 0.0)
    assert got[2].missing == ["month"] and got[2].reason == "missing: month" and got[2].reply.endswith("still need: month.")
    assert got[3].complete and (got[3].origin_airport_code, got[3].destination_airport_code, got[3].month) == ("A", "C", 1)
    assert got[3].reply == "How can I help you predict your flight delay?"
    assert got[4].missing == C.SLOT_FIELDS and got[4].last_prediction is None


def test_message_status_groups_the_log_once(spark):
    plan = K.status_from_messages(log(spark, [(1, "user", None, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def rows(spark, *pairs):
    return spark.createDataFrame(pairs, "session_id long, click double")


def test_upsert_sink_retries_and_compacts(spark):
    sink = SJ.UpsertSink(spark, shared_path(spark, "sink"), "session_id", compact_every=3)
    assert sink.read() is None
    state = lambda: {r.session_id: r.click for r in sink.read().collect()}
    sink.write(rows(spark, (1, 1.0), (2, 1.0)), 0)
    sink.write(rows(spark, (1, 2.0)), 1)
    sink.write(rows(spark, (1, 2.0)), 1)  # retried: replaced, not added
    assert spark.read.parquet(f"{sink.path}/changes").count() == 3 and state() == {1: 2.0, 2: 1.0}
    sink.write(rows(spark, (3, None)), 2)
    assert sink._numbers("snapshots", "upto=") == [2] and sink._numbers("changes", "batch=") == []
    assert state() == {1: 2.0, 2: 1.0, 3: None}
    sink.write(rows(spark, (3, None)), 2)  # retried after it was folded in
    assert state() == {1: 2.0, 2: 1.0, 3: None}
    for n in range(3, 12):
        sink.write(rows(spark, (n % 4, float(n))), n)
    assert state() == {0: 8.0, 1: 9.0, 2: 10.0, 3: 11.0}
    assert sink._numbers("snapshots", "upto=") == [8, 11] and sink._numbers("changes", "batch=") == []


def test_upsert_sink_ignores_a_torn_snapshot(spark, tmp_path):
    sink = SJ.UpsertSink(spark, str(tmp_path), "session_id", compact_every=100)
    sink.write(rows(spark, (1, 1.0)), 0)
    (tmp_path / "snapshots" / "upto=0").mkdir(parents=True)  # a write that was cut off
    assert sink.read().collect() == rows(spark, (1, 1.0)).collect()
    sink.compact(0)
    assert sink._numbers("snapshots", "upto=") == [0] and sink.read().count() == 1


def test_late_and_idle_sessions(spark):
    """A closed window is emitted once and evicted; an event behind the watermark is dropped; a later one opens a new window."""
    src, out, ck = (shared_path(spark, n) for n in ("late-src", "late-out", "late-ck"))
    schema = "session_id long, ts timestamp_ntz, seq long, slot string, value double"
    stream = lambda: spark.readStream.schema(schema).parquet(src)

    def feed(*events):
        spark.createDataFrame([(s, q, slot, v, t) for s, t, q, slot, v in events], "session_id long, seq long, slot string, value double, t string") \
            .select("session_id", F.col("t").cast("timestamp_ntz").alias("ts"), "seq", "slot", "value").write.mode("append").parquet(src)
        SJ.slot_state_stream_ttl(stream(), ["click"], "1 hour", out, ck).awaitTermination()
        return sorted((r.session_id, str(r.active_from)[11:16], r.click) for r in spark.read.parquet(out).collect())

    assert feed((1, "2024-01-01 00:00:00", 1, "click", 1.0), (1, "2024-01-01 00:30:00", 2, "click", 2.0), (2, "2024-01-01 04:00:00", 3, "click", 3.0)) == [(1, "00:00", 2.0)]
    assert feed((1, "2024-01-01 00:40:00", 4, "click", 9.0), (1, "2024-01-01 05:00:00", 5, "click", 4.0)) == [(1, "00:00", 2.0)]
    assert feed((3, "2024-01-01 12:00:00", 6, "click", 5.0)) == [(1, "00:00", 2.0), (1, "05:00", 4.0), (2, "04:00", 3.0)]


@pytest.mark.parametrize("bad, reason", [("MONTH=x", "MONTH"), ("DISTANCE=far", "DISTANCE"), ("+1", "columns"), ("-1", "columns")])
def test_rejected_lines_and_their_reasons(spark, tmp_path, bad, reason):
    names = [f.name for f in TB.FLIGHTS.fields]
    good = {n: "1" if n not in ("TAIL_NUMBER", "CANCELLATION_REASON") else "" for n in names}
    broken = dict(good)
    if "=" in bad:
        broken[bad.split("=")[0]] = bad.split("=")[1]
    line = ",".join(broken.values()) + (",1" if bad == "+1" else "")
    line = line.rsplit(",", 1)[0] if bad == "-1" else line
    (tmp_path / "flights.csv").write_text("\n".join([",".join(names), ",".join(good.values()), line, ""]))
    assert TB.read_flights_csv(spark, str(tmp_path / "flights.csv")).count() == 1
    assert [r.reason for r in TB.rejection_reasons(TB.rejected_flights(spark, str(tmp_path / "flights.csv"))).collect()] == [reason]


def test_name_index_equals_brute_force(spark):
    """Random short names with ties, repeats, an empty and a very long one, against all pairs in NumPy."""
    import math
    import random
    from collections import Counter

    from skylag.operators import search as S
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 9)))
    ents = [(i, f"c{i:02d}", word()) for i in range(40)] + [(40, "c40", None), (41, "c41", "")]
    names = [(i, word()) for i in range(120)] + [(200, "abc"), (201, "abc"), (202, ""), (203, "zzz"), (204, "ab" * 20_000), (205, None)]

    def grams(t):
        p = f"  {(t or '').lower()} "
        return Counter(p[i:i + 3] for i in range(len(p) - 2))
    df = Counter(g for _, _, t in ents for g in grams(t))
    idf = lambda g: math.log((len(ents) + 1) / (df[g] + 1))
    vec = lambda t: {g: c * idf(g) for g, c in grams(t).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))

    def distance(a, b):
        both = norm(a) * norm(b)
        return round(max(0.0, 1 - sum(x * b.get(g, 0.0) for g, x in a.items()) / both), 9) if both > 0 else 1.0
    vectors = [(i, vec(t)) for i, _, t in ents]
    want = {}
    for t in {t for _, t in names if t is not None}:
        v = vec(t)
        want[t] = sorted((distance(v, e), i) for i, e in vectors)[:4]
    got = {}
    e = spark.createDataFrame(ents, "entity_id int, code string, entity_name string")
    n = spark.createDataFrame(names, "name_id int, name string")
    for r in S.nearest_names(n, e, k=4).collect():
        got.setdefault(r.name, []).append((r.distance, r.entity_id))
    assert {t: sorted(x) for t, x in got.items()} == want
    out = {r.name_id: r for r in S.resolve_names(n, e, k=4).collect()}
    assert len(out) == len(names) and out[200][1:] == out[201][1:] and len(out[204].candidates) == 4
    assert out[205].code is None and out[205].candidates is None


def test_names_without_entities_and_without_names(spark):
    from skylag.operators import search as S
    ents, names = "entity_id int, code string, entity_name string", "name_id int, name string"
    got = S.resolve_names(spark.createDataFrame([(1, "x"), (2, None)], names), spark.createDataFrame([], ents)).collect()
    assert sorted((r.name_id, r.code, r.candidates) for r in got) == [(1, None, None), (2, None, None)]
    assert S.resolve_names(spark.createDataFrame([], names), spark.createDataFrame([(1, "A", "b")], ents)).count() == 0
    one = S.resolve_names(spark.createDataFrame([(1, "b"), (2, "a")], names),
                          spark.createDataFrame([(1, "A", "b"), (1, "a", "b")], ents).limit(1)).collect()
    assert sorted((r.name_id, r.code, r["match"]) for r in one) == [(1, "A", "similarity"), (2, "A", "exact")]


def test_name_index_joined_by_gram_gives_the_same(spark, monkeypatch):
    from skylag.operators import search as S
    e = spark.createDataFrame([(i, f"c{i}", f"port {i} of {'abcd'[i % 4]}") for i in range(30)], "entity_id int, code string, entity_name string")
    n = spark.createDataFrame([(i, f"por {i % 30} off {'abcd'[i % 3]}") for i in range(90)], "name_id int, name string")
    rows = lambda: sorted(map(str, S.resolve_names(n, e).collect()))
    want = rows()
    monkeypatch.setattr(S, "sized", lambda t, *_: t)
    assert rows() == want


def test_box_summary_from_value_counts(spark):
    """Ties, outliers on both sides, a null value, a null group and a group of one, against pandas."""
    import numpy as np

    from skylag.operators import profile as PR
    rng = np.random.default_rng(8)
    rows = [(g, float(v)) for g in "ab" for v in [*rng.integers(-20, 60, 300), 900, 900, -700]] + [("c", 5.0), ("a", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")

    def want(x):
        q1, med, q3 = np.quantile(x, [0.25, 0.5, 0.75])
        inside = (x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))
        return q1, med, q3, x[inside].min(), x[inside].max(), int((~inside).sum()), len(x)
    got = {r.g: tuple(r)[1:] for r in PR.box_summary(df, "v", ["g"]).collect()}
    assert got == {g: want(np.array([v for k, v in rows if k == g and v is not None])) for g in "abc"}
    assert tuple(PR.box_summary(df, "v").first()) == want(np.array([v for _, v in rows if v is not None]))


def test_request_features_join_the_trips_once(spark):
    """The fit and the requests read one written table of trips, with the rows of the joined one."""
    from skylag.plans import catalog as CT
    from skylag.plans.logs import Q
    d = "/root/testdata/sf0.001"
    plan = Q["e9_request_features"][0](spark, d)._jdf.queryExecution().toString()
    assert "l_orderkey" not in plan and "o_custkey" not in plan
    a, b = CT.trips(spark, d), CT.written_trips(spark, d)
    assert a.count() == b.count() and a.exceptAll(b).isEmpty()
