import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from cases import documents, prose

from skylag.llm import divergence, exact_dedup, periodic
from skylag.llm.registry import Q


def odd_documents():
    rng = random.Random(5)
    langs, sources = ["en", "de", None, "", "xx"], ["a", "b", "ü", None, "", "c" * 30]
    rows = [(i, t, rng.choice(langs[:4]), rng.choice(sources)) for i, t in documents(120)]
    rows += [(5000 + i, prose(rng, 40).upper() + " Straße x" + "long" * (i % 9), "en", "hot") for i in range(60)]
    rows += [(9000, "lonely words", "xx", "a"), (9001, None, "xx", "b"), (9002, "", "yy", None)]
    return rows


def sql(folder, text):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    return con.execute(text)


# ---- op13

def test_op13_equals_sql(spark, tables):
    rows = [r for r in odd_documents() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    rows += [(20000 + i, "one text with a third of all rows") for i in range(90)] + [(30000 + i, t) for i, t in enumerate([None, "", " "])]
    d = tables(documents=rows)
    got = Q["op13_exact_dedup"][0](spark, d).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(sql(d, exact_dedup.SQL).fetchall())


@pytest.mark.parametrize("filter_words", [exact_dedup.FILTER_WORDS, 0])
def test_op13_rows_that_stay(spark, filter_words):
    """Both plans of the filter; ties, null ids and clashing column names."""
    rows = [(1, "a", "x"), (2, "a", "y"), (2, "a", "z"), (None, "b", "u"), (None, "b", "v"), (3, None, "n"), (4, "", "n"), (5, "c", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string").selectExpr("*", "1 as word", "2 as id", "3 as maybe", "4 as doc")
    left = exact_dedup.deduplicate(df, filter_words=filter_words)
    assert left.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "", r.digest) for r in left.where("text <> 'c'").collect()) == [(0, "b", "v"), (2, "a", "z"), (4, "", "n")]
    marks = exact_dedup.find_duplicates(df, filter_words=filter_words).collect()
    assert Counter((r.group_size, r.kept) for r in marks) == {(3, True): 1, (3, False): 2, (2, True): 2, (2, False): 2, (1, True): 1}
    assert exact_dedup.find_duplicates(df.limit(0)).count() == 0 and exact_dedup.deduplicate(df.limit(0)).count() == 0


def test_op13_unique_rows_are_not_shuffled(spark):
    """Almost no unique row meets a filter of its table's size."""
    digests = spark.range(20_000).selectExpr("unhex(sha2(cast(id % 19000 as string), 256)) as digest", "id")
    bits = exact_dedup._word_bits(20_000)
    found = exact_dedup.repeated_filter(digests.select("digest"), bits)
    hit = exact_dedup._probe(digests, bits, found, exact_dedup.FILTER_WORDS).where("maybe").count()
    assert 2000 <= hit < 2200


# ---- op11

def test_op11_equals_sql(spark, tables, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_CELLS", 400)
    monkeypatch.setattr(divergence, "ROW_SOURCES", 2)
    d = tables(documents=odd_documents())
    got = Q["op11_source_divergence"][0](spark, d).select("lang", "source", "part", "item", "value", "rank").collect()
    want = sql(d, f"select lang, source, part, item, value, rank from ({divergence.SQL})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len({r.part for r in got}) == 2


def test_op11_empty_table(spark, tables):
    assert Q["op11_source_divergence"][0](spark, tables(documents=[])).count() == 0


def test_count_terms_equals_python():
    rng = random.Random(2)
    alphabet = "abzABZ é日🙂 .\x00-1"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 30, 400]))) for _ in range(80)]
    texts += ["q" * k + " " + "q" * k for k in range(1, 40)] + ["y" * 100_000, "", "end"]
    groups = np.sort(np.array([rng.randrange(4) for _ in texts]))
    n, docs = Counter(), defaultdict(set)
    for i, t in enumerate(texts):
        word = ""
        for c in t + " ":
            c = c.lower() if "A" <= c <= "Z" else c
            if "a" <= c <= "z" or ord(c) > 127:
                word += c
            elif word:
                n[groups[i], word] += 1
                docs[groups[i], word].add(i)
                word = ""
    g, terms, count, seen = divergence.count_terms(pa.array([""] + texts).slice(1), groups)
    keys = list(zip(g.tolist(), terms.to_pylist(), strict=True))
    assert dict(zip(keys, count.tolist(), strict=True)) == n and len(set(keys)) == len(keys)
    assert dict(zip(keys, seen.tolist(), strict=True)) == {k: len(v) for k, v in docs.items()}


# ---- op12

def smallest_period(ws):
    fail, k = [0] * len(ws), 0
    for i in range(1, len(ws)):
        while k and ws[i] != ws[k]:
            k = fail[k - 1]
        k += ws[i] == ws[k]
        fail[i] = k
    return len(ws) - fail[-1]


def brute_runs(ws):
    out = []
    for q in range(1, len(ws) // 3 + 1):
        i = 0
        while i + q < len(ws):
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q) and smallest_period(ws[i:j + q]) == q:
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out)


def brute_row(key, text):
    ws = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    if key is not None and ws and zlib.crc32(str(key).encode()) % 10 == 0:
        g = zlib.crc32(str(key).encode()) // 10
        a = g % len(ws)
        p = 1 + (len(ws) - a) // (3 + g % 8)
        ws = ws[:a] + [ws[a + (i - a) % p] for i in range(a, len(ws))]
    runs = brute_runs(ws)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (key, len(runs), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4),
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))


def periodic_documents():
    rng = random.Random(11)
    rows = documents(100)
    for i in range(150):
        parts = []
        for _ in range(rng.randint(1, 4)):
            unit = [rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 33, 64, 70]))]
            parts += unit * rng.randint(1, 9) + unit[:rng.randint(0, len(unit))] + [rng.choice("abcd") for _ in range(rng.randint(0, 20))]
        rows.append((10_000 + i, rng.choice([" ", "\n", " \t"]).join(parts)))
    rows += [(20_000, "a " * 700), (20_001, "a b " * 11 + "a"), (20_002, "a b " * 12), (20_003, ("x " * 5 + "y ") * 90), (20_004, "a " * 23), (20_005, "a " * 24)]
    rows += [(20_006, " ".join(random.Random(4).choices("ab", k=3000)))]
    return rows


@pytest.mark.parametrize("long_bytes", [periodic.LONG_BYTES, 200])
def test_op12_equals_brute_force(spark, tables, monkeypatch, long_bytes):
    """All documents tiled where they are read, and all but the shortest cut into groups of tiles."""
    find = periodic.find_runs
    monkeypatch.setattr(periodic, "find_runs", lambda docs, rule: find(docs, rule=rule, long_bytes=long_bytes, group_words=64))
    rows = periodic_documents()
    got = Q["op12_periodic_runs"][0](spark, tables(documents=rows)).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    want = sorted((brute_row(i, t) for i, t in rows), key=key)
    assert sorted(map(tuple, got), key=key) == want and sum(r.n_runs > 1 for r in got) > 20


def test_op12_tiles_find_every_run():
    rng = random.Random(8)
    for _ in range(400):
        ws = []
        while len(ws) < 120:
            unit = [rng.choice("ab") for _ in range(rng.randint(1, 24))]
            ws += unit * rng.randint(1, 5)
        codes = np.array([ord(w) for w in ws])
        far = periodic._next_gram(codes, np.zeros(len(ws), np.int8))
        found = [f for step in periodic._steps(len(ws)) for f in periodic.solve(codes.tolist(), far, step)]
        assert sorted((s, e - s + q, q) for q, s, e in found if e - s + q >= max(24, 3 * q)) == brute_runs(ws)


def test_op12_empty_table_and_other_columns(spark, tables):
    assert Q["op12_periodic_runs"][0](spark, tables(documents=[])).count() == 0
    df = spark.createDataFrame([("k", "a " * 30, 7)], "doc_id string, text string, row int").selectExpr("*", "1 as frags", "2 as n")
    r = periodic.find_runs(df).first()
    assert r.id == "k" and [tuple(x) for x in r.runs] == [(0, 1, 30)]
