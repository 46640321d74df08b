"""Language identification: the family first, then the language in it.

Features are hashed byte 1- to 3-grams of the lower-cased text, as shares.
One-versus-one linear support vector machines (squared hinge loss, dual
coordinate descent) separate the families, and within a family its
languages; the largest sum of signed margins wins. The score is the product
of the two levels' confidences, each a logistic function of the winner's
smallest margin.

Fitted on the driver from a bounded sample: per language the ``PER_LANG``
learnable documents with the lowest hash of doc_id, texts of at most
``FIT_CHARS`` characters; each gives itself and a short piece, so that short
texts are known, too. Every document is predicted from its whole text.

Defined results: ``und`` with score 0 for a null text or one without a
letter, or if nothing could be learnt; with one language learnt, that
language; languages that ``FAMILIES`` lacks form a family each; rows without
text, language or doc_id don't train; repeated rows get a row each; an empty
table gives none; other columns are kept (a column with the name of an output
column is replaced).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frame_schema, small, table

#: Fixed: families of language codes.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fo fy lb yi",
    "romance": "fr es it pt ro ca gl oc rm la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "semitic": "ar he am",
    "indo-aryan": "hi ur bn mr gu pa ne",
}
FAMILY = {c: f for f, codes in FAMILIES.items() for c in codes.split()}
PER_LANG, FIT_CHARS, PIECE = 300, 20_000, 80
DIM = 1 << 13
STEP = 1 << 20  # bytes counted at a time
COST, EPOCHS = 20.0, 12
_LETTER = regex.compile(r"\p{L}")


def grams(text: str) -> np.ndarray:
    """Shares of the hashed 1- to 3-grams (float32, DIM long)."""
    raw = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode(), np.uint8)
    out, n = np.zeros(DIM), 0
    for at in range(0, len(raw), STEP):
        a = raw[at:at + STEP + 2].astype(np.uint32)
        last = at + STEP >= len(raw)
        for k in (1, 2, 3):
            code = a[:len(a) - k + 1] + np.uint32(0x100 * k)
            for j in range(1, k):
                code = code * np.uint32(0x01000193) ^ a[j:len(a) - k + 1 + j]
            code = code if last else code[:STEP]
            code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)
            out += np.bincount(code, minlength=DIM)
            n += len(code)
    return np.sqrt(out / max(1, n)).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a linear machine (y is -1 or 1; the last column is the bias)."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, alpha = np.zeros(x.shape[1], np.float32), np.zeros(len(x))
    diag = (x * x).sum(1) + 1 / (2 * COST)
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(x)):
            g = y[i] * float(x[i] @ w) - 1 + alpha[i] / (2 * COST)
            new = max(0.0, alpha[i] - g / diag[i])
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
    return w


@dataclass
class OneVersusOne:
    """Linear machines between each two of the labels."""
    labels: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None

    def fit(self, x: np.ndarray, names: list[str]) -> "OneVersusOne":
        names = np.array(names)
        self.pairs = list(combinations(range(len(self.labels)), 2))
        ws = []
        for a, b in self.pairs:
            own = (names == self.labels[a]) | (names == self.labels[b])
            ws.append(svm(x[own], np.where(names[own] == self.labels[a], 1.0, -1.0)))
        self.weights = np.array(ws, np.float32) if ws else None
        return self

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        if self.weights is None:
            return self.labels[0], 1.0
        m = self.weights[:, :-1] @ x + self.weights[:, -1]
        total, least = np.zeros(len(self.labels)), np.full(len(self.labels), np.inf)
        for (a, b), v in zip(self.pairs, m.tolist(), strict=True):
            for k, s in ((a, v), (b, -v)):
                total[k] += s
                least[k] = min(least[k], s)
        k = int(total.argmax())
        return self.labels[k], float(1 / (1 + np.exp(-3 * least[k])))


@dataclass
class Model:
    family: OneVersusOne | None = None
    inside: dict = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or self.family is None or not _LETTER.search(text):
            return "und", 0.0
        x = grams(text)
        f, p = self.family.predict(x)
        lang, q = self.inside[f].predict(x)
        return lang, p * q


def fit(rows: list[tuple[str, str]]) -> Model:
    """Model from (text, lang) rows."""
    rows = [(t, lang) for t, lang in rows if _LETTER.search(t)]
    if not rows:
        return Model()
    x, names = [], []
    for t, lang in rows:
        mid = len(t) // 2
        for piece in (t, t[mid:mid + PIECE]):
            x.append(grams(piece))
            names.append(lang)
    x = np.array(x)
    fam = [FAMILY.get(n, n) for n in names]
    model = Model(OneVersusOne(sorted(set(fam))).fit(x, fam))
    for f in model.family.labels:
        own = [i for i, g in enumerate(fam) if g == f]
        langs = [names[i] for i in own]
        model.inside[f] = OneVersusOne(sorted(set(langs))).fit(x[own], langs)
    return model


def train(docs: DataFrame, learnable=None) -> Model:
    """Model from the rows of ``docs`` that ``learnable`` (a condition on
    doc_id) admits."""
    own = docs.where("text is not null and lang is not null and doc_id is not null")
    if learnable is not None:
        own = own.where(learnable)
    ids = own.where(F.length("text") <= FIT_CHARS).select("lang", "doc_id", F.xxhash64("doc_id").alias("h"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    some = ids.withColumn("r", rank).where(F.col("r") <= PER_LANG).select("doc_id", "lang").distinct()
    rows = (own.where(F.length("text") <= FIT_CHARS).select("doc_id", "lang", "text")
            .join(F.broadcast(some), ["doc_id", "lang"]).collect())
    return fit([(r.text, r.lang) for r in sorted(rows, key=lambda r: (r.doc_id, r.lang, r.text))])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score``."""
    schema = frame_schema(docs, "lang_pred string, score double")
    names = [f.name for f in schema.fields]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in small(batches):
            got = [m.predict(t) for t in b.column(text).to_pylist()]
            new = {"lang_pred": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64())}
            yield pa.RecordBatch.from_arrays([new[n] if n in new else b.column(n) for n in names], names)

    return docs.mapInArrow(run, schema)


def op6_language(spark, sf_dir: str) -> DataFrame:
    """All documents, learnt from those whose remainder is not 0."""
    docs = table(spark, sf_dir, "documents")
    rest = F.crc32(F.col("doc_id").cast("string")) % 5
    model = train(docs.select("doc_id", "lang", "text"), rest != 0)
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
