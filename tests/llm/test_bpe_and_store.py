import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from cases import documents
from tokenizers import Tokenizer

from skylag.llm import bpe, token_store
from skylag.llm.registry import Q

MULTI, PLAIN = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def multi():
    return bpe.PieceEncoder(bpe.vocabulary_json(MULTI))


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.parse_ranks(open(MULTI).read())
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda t: np.array(enc.encode_ordinary(t), "<u4").tobytes()


def test_pattern_is_the_public_one():
    assert bpe.PATTERN == P.PATTERN


def test_ids_equal_tiktoken(multi, reference):
    import random
    rng = random.Random(5)
    parts = ["a", "Ab", " ", "  ", "   ", "\n", "\t", "'s", "'LL", "é", "日本", " ", "\x1c", "1", "²", "!", "🙂", "...", "\r\n", "\x00",
             "<|endoftext|>", "́", "ǅ", "ʰ"]
    for t in [x for _, x in documents() if x] + ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(4000)]:
        ids = multi.encode(t)
        assert ids == reference(t), repr(t)
        assert multi.decode(ids) == t.encode()


def test_ids_equal_the_library_by_default(multi, reference):
    """White space of all kinds in a row, words with marks, added tokens."""
    import random
    rng = random.Random(9)
    plain, enc = Tokenizer.from_file(PLAIN), bpe.PieceEncoder(bpe.vocabulary_json(PLAIN))
    parts = ["a", "word", "é,", "x!", ".", "'s", " ", " ", " ", "\u00a0", "\x85", "\u2003", "\n", "\t", "\x1c", "7"]
    texts = ["a \u00a0 \u00a0", "a<|endoftext|>b", "a <|endoftext|> b", "?", " , ", "b.", " b.", "<|endoftext|>" * 3]
    texts += ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(20_000)]
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)
        assert multi.encode(t) == reference(t), repr(t)
    assert np.frombuffer(enc.encode(texts[1]), "<u4").tolist() == [64, 50256, 65]


def test_long_texts_are_cut_without_a_trace(multi, reference, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 50)
    for _, t in documents():
        if t:
            assert multi.encode(t) == reference(t)


def test_a_full_cache_changes_nothing(multi, reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    assert all(multi.encode(t) == reference(t) for _, t in documents() if t)


def test_offsets_cover_split_characters(multi):
    t = "é日本🙂x"
    ids = multi.encode(t)
    a, z, split = multi.offsets(t, ids)
    pieces = [multi.table[i] for i in np.frombuffer(ids, "<u4")]
    at = 0
    for x, y, p in zip(a, z, pieces, strict=True):
        whole = t[x:y].encode()
        assert p in whole and len(t[:x].encode()) <= at
        at += len(p)
    assert at == len(t.encode()) and split == sum(
        not (p.decode("utf-8", "ignore").encode() == p) for p in pieces)


def test_op5(spark, tables, reference):
    import hashlib
    d = tables(documents=documents())
    rows = Q["op5_byte_bpe"][0](spark, d).collect()
    want = sorted((x is not None, x or 0, hashlib.sha256(reference(t or "")).hexdigest(), len(reference(t or "")) // 4,
                   hashlib.sha256((t or "").encode()).hexdigest()) for x, t in documents())
    assert want == sorted((r.doc_id is not None, r.doc_id or 0, r.ids_sha256, r.n_tokens, r.decoded_sha256) for r in rows)
    assert Q["op5_byte_bpe"][0](spark, tables(documents=[])).count() == 0


def test_clashing_columns_and_null_ids(spark):
    code = bpe.vocabulary_json(MULTI)
    df = spark.createDataFrame([(1, "a b", "old"), (2, None, None)], "x int, text string, ids string")
    r = bpe.decode(bpe.encode(df, code, offsets=True), code).orderBy("x").collect()
    assert bytes(r[0].decoded) == b"a b" and bytes(r[1].ids) == b"" and len(r[0].starts) == len(r[0].ids)
    none = bpe.decode(spark.createDataFrame([(None,)], "ids binary"), code).first()
    assert none.decoded is None


def test_encode_checked_equals_encode(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in documents()], "doc_id long, text string, n_split string")
    code = bpe.vocabulary_json(MULTI)
    want = sorted((str(r.doc_id), r.ids) for r in bpe.encode(df, code).collect())
    got = bpe.encode_checked(df, code, pieces=50)
    assert got.columns == ["doc_id", "n_split", "ids", "n_tokens", "round_trip"]
    rows = got.collect()
    assert sorted((str(r.doc_id), r.ids) for r in rows) == want and all(r.round_trip and r.n_tokens == len(r.ids) // 4 for r in rows)
    assert bpe.encode_checked(df.limit(0), code).count() == 0


def test_op1_round_trip(spark, tables):
    docs = documents()
    tok = Tokenizer.from_file(PLAIN)
    d = tables(documents=docs)
    rows = Q["op1_token_ids"][0](spark, d).collect()
    enc = {t: np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for _, t in docs}
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in rows) == sorted(
        (x is not None, x or 0, len(enc[t]), zlib.crc32(enc[t].tobytes())) for x, t in docs)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(rows, key=lambda r: r.start) if r.doc_id is not None]
    assert ids == sorted(ids)
    assert Q["op1_token_ids"][0](spark, tables(documents=[])).count() == 0


def test_short_document_access(spark, tmp_path):
    docs = [(i, t) for i, t in documents() if i is not None]
    path = str(tmp_path / "store")
    code = bpe.vocabulary_json(PLAIN)
    token_store.write(spark.createDataFrame(docs, "doc_id long, text string"), path, code)
    files = [r.file for r in spark.read.parquet(path + "/manifest").collect()]
    enc = bpe.PieceEncoder(code)
    for i in (1, docs[7][0], docs[-3][0]):
        own = [t for x, t in docs if x == i]
        assert token_store.fetch(path, files, i) == [enc.encode(t or "") + b"\0\0\0\0" for t in own]
    (tmp_path / "store" / "dictionary.zdict").write_bytes(b"another")
    with pytest.raises(ValueError):
        token_store.fetch(path, files, 1)
