import collections
import random

import public_tokenizers as P
from cases import documents, prose

import corpus_pipeline
from skylag.llm import bpe, decontam, pii, rollup
from skylag.llm.registry import Q
from skylag.session import shared_path

ROW = "op string, doc_id long, source string, lang string, n_tokens long"


def test_random_batches_equal_a_recount(spark):
    rng = random.Random(3)
    store, now = rollup.Rollup(spark, shared_path(spark, "test-rollup")), {}
    for k in range(4):
        rows = {}
        for _ in range(12):
            i = rng.choice([None, *range(8)])
            rows[i] = (rng.choice(["insert", "revise", "delete"]), i, rng.choice(["s", "t", None]), rng.choice(["en", None]), rng.choice([0, 5, None]))
        for op, i, s, g, n in rows.values():
            if (op == "insert") == (i not in now):
                if op == "delete":
                    del now[i]
                else:
                    now[i] = (s, g, n or 0)
        batch = spark.createDataFrame(list(rows.values()), ROW)
        assert store.commit(f"b{k}", batch, "v1")
        assert not store.commit(f"b{k}", batch, "v1")
        want = collections.defaultdict(lambda: [0, 0])
        for s, g, n in now.values():
            want[s, g][0] += 1
            want[s, g][1] += n
        got = {(r.source, r.lang): [r.docs, r.tokens] for r in store.totals().collect()}
        assert got == dict(want)
    assert store.commit("empty", spark.createDataFrame([], ROW), "v1") and store.commit("v2", batch, "v2")
    assert {r.version for r in store.totals().collect()} <= {"v1", "v2"}


def test_a_lost_attempt_counts_nothing(spark):
    store = rollup.Rollup(spark, shared_path(spark, "test-rollup"))
    rows = spark.createDataFrame([("insert", 1, "s", "en", 3)], ROW)
    store.commit("a", rows, "v")
    spark.createDataFrame([("v", "s", "en", 9, 9)], rollup.DELTA).write.parquet(f"{store.path}/batches/b/lost/delta")
    assert [(r.docs, r.tokens) for r in store.totals().collect()] == [(1, 3)]


def test_operations_of_one_document_are_netted(spark):
    store = rollup.Rollup(spark, shared_path(spark, "test-net"))
    put = lambda name, *rows: store.commit(name, spark.createDataFrame(rows, ROW), "v")
    total = lambda: {(r.source, r.lang): (r.docs, r.tokens) for r in store.totals().collect()}
    put("a", ("revise", 1, "s", "en", 5), ("insert", 1, "s", "en", 3), ("insert", 2, "t", "de", 4), ("insert", 2, "t", "de", 6))
    assert total() == {("s", "en"): (1, 5), ("t", "de"): (1, 6)}
    put("b", ("insert", 1, "u", "fr", 7), ("delete", 1, None, None, None), ("delete", 2, None, None, 0), ("revise", 2, "t", "de", 9))
    assert total() == {("u", "fr"): (1, 7)}
    put("c", ("delete", 1, None, None, 0), ("insert", 1, "u", "fr", 7), ("revise", 3, "s", "en", 1))
    assert total() == {("u", "fr"): (1, 7)} and store.ledger().count() == 1
    put("d", ("insert", 3, "s", "en", 1), ("revise", 3, "s", "en", 2), ("delete", 3, "s", "en", 2), ("insert", 1, "x", "x", 1))
    assert total() == {("u", "fr"): (1, 7), ("s", "en"): (1, 2)}


def test_op7_equals_a_recount(spark, tables):
    docs = [(i, t, "en" if i and i % 2 else None, f"s{(i or 0) % 3}") for i, t in documents()]
    labels = [(i, int(i % 5 != 0), int(i % 4 == 0)) for i, _, _, _ in docs if i is not None][::2]
    enc = bpe.PieceEncoder(bpe.vocabulary_json(P.path("byte_bpe_50k.json")))
    count = lambda t: len(enc.encode(t or "")) // 4
    best = {}
    for i, t, g, s in docs:
        if i not in best or count(t) > count(best[i][0]):
            best[i] = (t, s, g)
    poor, bad = {i for i, q, _ in labels if q == 0}, {i for i, _, x in labels if x == 1}
    want = collections.Counter(), collections.Counter()
    for i, (t, s, g) in best.items():
        if i not in poor:
            want[0][s, g] += 1
            want[1][s, g] += count((t or "").replace("\n", " ") if i in bad else t)
    rows = Q["op7_token_rollup"][0](spark, tables(documents=docs, labels=labels)).collect()
    assert {(r.source, r.lang): (r.docs, r.tokens) for r in rows} == {k: (want[0][k], want[1][k]) for k in want[0]}
    assert Q["op7_token_rollup"][0](spark, tables(documents=[], labels=[])).count() == 0


def test_pipeline_catches_planted_and_keeps_clean(spark, tables):
    rng, docs, labels = random.Random(11), [], []
    slurs = ["gronkhead", "vilescum", "blathoid", "zorptrash"]
    for i in range(400):
        ws = prose(rng, 60).split()
        if i % 8 == 0:
            for _ in range(4):
                ws.insert(rng.randrange(len(ws)), rng.choice(slurs))
        docs.append((i, " ".join(ws), "en", "s", 0))
        labels.append((i, 1, int(i % 8 == 0)))
    item = prose(rng, 20)
    copy = docs[9][1].split()
    copy[3] = "changed"
    docs += [(1000, " ".join(copy), "en", "s", 0), (1001, docs[9][1], "en", "s", 0), (1002, prose(rng, 20) + " " + item, "en", "s", 0),
             (1003, prose(rng, 30) + " mail me@my.example.com", "fr", "s", 0), (1004, None, None, None, None), (1005, "", "en", "s", 0),
             docs[1], (None, prose(rng, 30), "en", "s", 0)]
    d = tables(documents=docs, labels=labels, benchmark=[(1, item)])
    stage, names = spark.read.parquet(f"{d}/documents.parquet"), None
    names = stage.columns
    for name, fn in corpus_pipeline.STAGES[:-1]:
        stage = fn(spark, stage, d)
        assert stage.columns == names, name
    rows = {r.doc_id: r for r in stage.collect()}
    clean = {i for i in range(400) if i % 8} - {9} | {9, 1003, 1004, 1005, None}
    assert set(rows) == clean and stage.count() == len(clean)
    assert rows[1003].text.endswith("mail <EMAIL>") and rows[1003].n_chars == len(rows[1003].text)
    out = corpus_pipeline.run(spark, d).collect()
    enc = bpe.PieceEncoder(bpe.vocabulary_json(P.path("byte_bpe_multi_50k.tiktoken")))
    assert {(r.doc_id, bytes(r.ids)) for r in out} == {(i, enc.encode(r.text or "")) for i, r in rows.items()}
    assert all(r.round_trip for r in out)


def test_near_dedup_equals_brute_force_on_five_words(spark, tables):
    """Pairs alike on two words but not on five stay; groups follow the links on five."""
    rng, docs = random.Random(21), []
    for i in range(40):
        ws = [f"{w}{k}" for k, w in enumerate(prose(rng, 60).split())]
        docs.append((10 * i, " ".join(ws)))
        for n, at in enumerate(((30,), (15, 40), (10, 28, 50), (8, 20, 35, 52))[:1 + i % 4], 1):
            other = list(ws)
            for k in at:
                other[k] = f"changed{i}x{n}x{k}"
            docs.append((10 * i + n, " ".join(other)))
    docs += [(1000, "four words are one"), (1001, "Four words are one"), (1002, "four words are two"), (1003, None), (1004, "")]

    def alike(size):
        def of(t):
            ws = (t or "").lower().split()
            return {tuple(ws)} if 0 < len(ws) < size else set(zip(*(ws[k:] for k in range(size)), strict=False))
        sets = [(i, of(t)) for i, t in docs]
        return [(a, b) for n, (a, x) in enumerate(sets) for b, y in sets[n + 1:] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    links = alike(5)
    assert len(set(alike(2)) - set(links)) >= 30 and len(links) >= 30
    group = {i: i for i, _ in docs}
    for _ in docs:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    d = tables(documents=docs)
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    assert sorted(r.doc_id for r in got.collect()) == [i for i, _ in docs if group[i] == i]


def test_pipeline_of_nothing(spark, tables):
    d = tables(documents=[], labels=[], benchmark=[])
    assert corpus_pipeline.run(spark, d).count() == 0


def test_stages_agree_with_their_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "redact", "tokens"]
    assert pii.KINDS == ("email", "ip", "card", "phone") and decontam.WIDTH == 10


def test_pipeline_clashing_columns_repeated_ids_and_settings(spark, tmp_path):
    """Extra columns of any name survive, a repeated doc_id keeps one text whatever the file layout, the session stays as it was."""
    rng = random.Random(4)
    texts = [prose(rng, 30) for _ in range(12)]
    rows = [(i % 9, t, "en", "s", len(t), f"id{i}", i, "w", {"k": i}) for i, t in enumerate(texts)]
    names = "doc_id long, text string, lang string, source string, n_chars long, __id string, __score int, row string, spans map<string,int>"
    got = []
    for k, (order, parts) in enumerate(((1, 1), (-1, 5))):
        docs = spark.createDataFrame(rows[::order], names).repartition(parts)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            d = str(tmp_path / f"{k}-{name}")
            (tmp_path / "in").mkdir(exist_ok=True)
            if not (tmp_path / "in" / "labels.parquet").exists():
                spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "in" / "labels.parquet"))
                spark.createDataFrame([(1, "no such words")], "item_id long, text string").write.parquet(str(tmp_path / "in" / "benchmark.parquet"))
            stage(spark, docs, str(tmp_path / "in")).write.parquet(d)
            docs = spark.read.parquet(d)
        assert docs.columns == [c.split()[0] for c in names.split(", ")]
        got.append(sorted((r.doc_id, r.text, r["__id"], r["__score"], r.row, r.spans["k"]) for r in docs.collect()))
    assert got[0] == got[1] and [r[0] for r in got[0]] == list(range(9)) and all(r[2] == f"id{r[3]}" for r in got[0])
    spark.createDataFrame([r[:5] for r in rows], ", ".join(names.split(", ")[:5])).write.parquet(str(tmp_path / "in" / "documents.parquet"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4321)
    assert corpus_pipeline.run(spark, str(tmp_path / "in")).count() == 9
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "4321"
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
