"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary
text. Every window (``WINDOW`` words, behind a fixed lead that both
dictionaries hold, so that a frame's fixed costs are paid alike) is
compressed with either; the difference of the two lengths says which text it
is closer to. A document's score is a logistic function of its largest
differences, of how many windows pass the calibrated difference, and of its
length.

Dictionary samples are windows: for the toxic one those that hold character
n-grams over-represented in toxic documents, for the ordinary one those of
ordinary documents. Documents that share their smallest word hash (copies)
count once.

Fitted on the driver from a bounded sample of labelled rows: per class the
``TOXIC_DOCS`` / ``ORDINARY_DOCS`` lowest hashes of doc_id, texts of at most
``FIT_CHARS`` characters; every fourth of them calibrates, the others train
the dictionaries. Every document is scored whole.

Defined results: null, empty and wordless texts get the score of a document
without windows; a doc_id with several labels counts as toxic if one says
so; rows without label, text or doc_id don't train; without a class in the
sample every score is the sample's toxic share; repeated rows get a row
each; an empty table gives none; other columns are kept (a column with the
name of an output column is replaced).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frame_schema, kept, small, table

TOXIC_DOCS, ORDINARY_DOCS, FIT_CHARS = 1500, 3000, 20_000
WINDOW = 1
DICT_BYTES, LEVEL = 12_000, 13
GRAMS, MIN_SHARE, OVER = (3, 4, 5, 6), 0.02, 20
LEAD = " the carrier "
REJECT = 0.7
CACHE = 200_000
_SPLIT = re.compile(r"\W+")


def _words(text: str) -> list[str]:
    return [w for w in _SPLIT.split(text.lower()) if w]


def _windows(text: str | None) -> list[str]:
    ws = _words(text) if text else []
    return ws if WINDOW == 1 else [" ".join(ws[i:i + WINDOW]) for i in range(0, len(ws), WINDOW)]


def _groups(texts: list[str]) -> list[set[str]]:
    out = defaultdict(set)
    for t in texts:
        if ws := set(_words(t)):
            out[min(zlib.crc32(w.encode()) for w in ws)] |= ws
    return list(out.values())


def _grams(ws) -> set[str]:
    return {w[i:i + n] for w in ws for n in GRAMS for i in range(len(w) - n + 1)}


def _dictionary(windows: Counter) -> bytes:
    """Trained dictionary, or the raw windows if they are too few to train."""
    import zstandard
    often = sorted(windows.items(), key=lambda x: (-x[1], x[0]))[:8000]
    samples = [(LEAD + " " + w + " ").encode() for w, n in often for _ in range(min(n, 30))]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return (" ".join(w for w, _ in reversed(often))[-DICT_BYTES:] + LEAD).encode()


class Distance:
    """Window -> compressed length under the ordinary less under the toxic
    dictionary (cached, bounded)."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        import zstandard as z
        params = z.ZstdCompressionParameters.from_level(
            LEVEL, source_size=64, dict_size=DICT_BYTES, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=0,
            write_checksum=0, write_dict_id=0, min_match=3)

        def coder(raw):
            d = z.ZstdCompressionDict(raw)
            d.precompute_compress(compression_params=params)
            return z.ZstdCompressor(dict_data=d, compression_params=params).compress
        self.toxic, self.ordinary = coder(toxic), coder(ordinary)
        self.seen: dict[str, int] = {}

    def __call__(self, window: str) -> int:
        got = self.seen.get(window)
        if got is None:
            if len(self.seen) > CACHE:
                self.seen.clear()
            raw = (LEAD + " " + window + " ").encode()
            got = self.seen[window] = len(self.ordinary(raw)) - len(self.toxic(raw))
        return got

    def features(self, text: str | None, limit: int) -> np.ndarray:
        d = np.fromiter(map(self, _windows(text)), np.int64)
        top = np.sort(d[-3:] if len(d) < 4 else np.partition(d, -3)[-3:])[::-1] if len(d) else []
        out = np.zeros(6)
        out[:len(top)] = np.maximum(top, 0)
        n = int((d >= limit).sum()) if len(d) else 0
        out[3:] = np.log1p(n), n / (1 + len(d)), np.log1p(len(d))
        return out


@dataclass
class Model:
    share: float
    toxic: bytes = b""
    ordinary: bytes = b""
    limit: int = 1
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None


def fit(rows: list[tuple[int, str, int]]) -> Model:
    """Model from (doc_id, text, toxic) rows, most useful in hash order."""
    share = float(np.mean([r[2] for r in rows])) if rows else 0.0
    learn, held = [r for i, r in enumerate(rows) if i % 4], rows[::4]
    t, o = _groups([r[1] for r in learn if r[2]]), _groups([r[1] for r in learn if not r[2]])
    if not t or not o or len({r[2] for r in held}) < 2:
        return Model(share)
    a, b = Counter(), Counter()
    for g in t:
        a.update(_grams(g))
    for g in o:
        b.update(_grams(g))
    over = {g for g, k in a.items() if k >= max(3, MIN_SHARE * len(t)) and k / len(t) >= OVER * (b[g] + 0.5) / len(o)}
    bad, good = Counter(), Counter()
    for g in t:
        bad.update(w for w in g if any(w[i:i + n] in over for n in GRAMS for i in range(len(w) - n + 1)))
    for g in o:
        good.update(w for w in g if w not in bad)
    if not bad or not good:
        return Model(share)
    model = Model(share, _dictionary(bad), _dictionary(good))
    far = Distance(model.toxic, model.ordinary)
    y = np.array([r[2] for r in rows], float)
    most = np.array([max(map(far, _windows(r[1])), default=0) for r in rows])
    model.limit = max(range(1, 16), key=lambda k: (most[y == 1] >= k).mean() - (most[y == 0] >= k).mean())
    use = np.array([i % 4 == 0 for i in range(len(rows))])
    x = np.array([far.features(r[1], model.limit) for r, u in zip(rows, use, strict=True) if u])
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
    model.weights = _logistic((x - model.mean) / model.scale, y[use])
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, learnable=None) -> Model:
    """Model from the labelled rows of ``docs`` that ``learnable`` (a
    condition on doc_id) admits."""
    own = labels.where("toxic is not null and doc_id is not null")
    if learnable is not None:
        own = own.where(learnable)
    own = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    ids = [r for k, n in ((1, TOXIC_DOCS), (0, ORDINARY_DOCS))
           for r in own.where(F.col("toxic") == k).orderBy("h", "doc_id").limit(n).collect()]
    if not ids:
        return Model(0.0)
    spark = docs.sparkSession
    some = spark.createDataFrame([(r.doc_id, r.toxic, r.h) for r in ids], "doc_id long, toxic int, h long")
    rows = (docs.where(F.length("text") <= FIT_CHARS).select("doc_id", "text").join(F.broadcast(some), "doc_id").collect())
    return fit([(r.doc_id, r.text, r.toxic) for r in sorted(rows, key=lambda r: (r.h, r.doc_id, r.text))])


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds ``out`` (double, 0 to 1)."""
    schema = frame_schema(docs, f"{out} double")
    names = [f.name for f in schema.fields]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        far = kept(("toxicity", m.toxic, m.ordinary), lambda: Distance(m.toxic, m.ordinary)) if m.weights is not None else None
        for b in small(batches):
            if m.weights is None:
                p = np.full(b.num_rows, m.share)
            else:
                x = np.array([far.features(t, m.limit) for t in b.column(text).to_pylist()]).reshape(b.num_rows, 6)
                z = (x - m.mean) / m.scale @ m.weights[:-1] + m.weights[-1]
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([pa.array(p) if n == out else b.column(n) for n in names], names)

    return docs.mapInArrow(run, schema)


def remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents, the model fitted on labels whose remainder is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    return score(docs, model).select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score",
                                     (F.col("score") >= REJECT).cast("int").alias("predicted"))
