"""Personal data: base patterns plus candidates judged by boosted trees.

*Base spans* are the leftmost non-overlapping matches of four fixed patterns
(email, ip, card, phone) that pass their checks; they always stay.
*Candidate generators* propose more, overlapping spans with a high recall:
split or obfuscated addresses, numbers next to other numbers, numbers without
a country code. Gradient-boosted trees judge each candidate by its format
(length, digits, separators, checksum, ...) and its context (the characters
beside it); a candidate whose score passes its kind's
calibrated threshold and that overlaps no base span is added, best score
first.

No labelled spans exist, so the trees learn from the base: candidates equal
to a base span are positive; those that fail the kind's check, and those that
cut or exceed a base span of their kind, are negative; the rest is left out.
The fit takes every such candidate of every whole text: the cuts are exact
quantiles, candidates with equal cuts, kind and label are counted together, and
a level of a tree is grown from sums over these counts (by Spark tasks if there
are more than ``LOCAL_ROWS`` of them). The documents whose hash of doc_id is
divisible by four calibrate: a kind's threshold keeps ``KEEP`` of its positives
there and is 0.5 at least.

Defined results: null, empty and blank texts have no spans; offsets are code
points, ends exclusive; repeated rows get a row each; an empty table gives
none; other columns are kept (a column with the name of an output column is
replaced). Texts are scanned whole; long digit runs take linear time.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.tables import path_size, spread
from .common import frame_schema, is_small, kept, small, table

KINDS = ("email", "ip", "card", "phone")
KEEP = 0.98
WIDTH, CUTS = 19, 24     # features of a candidate, cuts of a feature at most
LOCAL_ROWS = 100_000     # counted candidates up to which the driver sums them itself
# fixed base patterns, written so that long runs of digits take linear time
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# generators of candidates
_PROPOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}"
                        r"(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{2,63}){1,5}"),
    "ip": re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])(?=([0-9]{13,19}(?![0-9])|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}(?![0-9])"
                       r"|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])))"),
    "phone": re.compile(r"(?<![0-9])(?=((?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
                        r"|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])))"),
}
_AT, _DIGIT = re.compile(r"@|\(at\)|\[at\]"), re.compile("[0-9]")
_PART, _TAIL = re.compile(r"[^A-Za-z0-9]+"), re.compile(r"[^A-Za-z0-9]+[A-Za-z0-9]+[^A-Za-z0-9]*$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def valid(kind: str, s: str) -> bool:
    """The check of a kind on matched text."""
    digits = "".join(c for c in s if "0" <= c <= "9")
    if kind == "ip":
        return all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in re.findall("[0-9]+", s))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def _emails(text: str) -> list[tuple[int, int]]:
    out, at, end = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _HOST.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind, then start."""
    out = [("email", a, z) for a, z in _emails(text)]
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m.group())]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Proposed spans, overlapping each other and the base: each match and the
    match without its first or last part (or character, if it is in one part)."""
    out = []
    digit = _DIGIT.search(text)
    for kind, pattern in _PROPOSE.items():
        if not (_AT.search(text) if kind == "email" else digit):
            continue
        for m in pattern.finditer(text):
            a, z = m.span(1) if pattern.groups else m.span()
            s = text[a:z]
            first, last = _PART.search(s, 1), _TAIL.search(s)
            out += [(kind, a, z), (kind, a + first.end() if first and first.end() < len(s) else a + 1, z),
                    (kind, a, a + last.start() if last and last.start() else z - 1)]
    return out


def features(text: str, kind: str, a: int, z: int) -> list[float]:
    """Format and context of a candidate."""
    s = text[a:z]
    digits = [c for c in s if "0" <= c <= "9"]
    runs = re.findall("[0-9]+", s)
    left, right = text[a - 1:a], text[z:z + 1]
    side = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4 if c in ".,;:!?" else 5
    return [KINDS.index(kind), len(s), len(digits), len(runs), max(map(len, runs), default=0),
            s.count(" "), s.count("-"), s.count("."), s.startswith("+"), "(" in s, "@" in s,
            sum(c.isalpha() for c in s), len(set(digits)), luhn("".join(digits)) if digits else 0,
            max((int(r[:6]) for r in runs), default=0), len(s) - s.rfind(".") - 1,
            side(left), side(right), int(digits[0]) if digits else -1]


@dataclass
class Boost:
    """Gradient-boosted regression trees on the logistic loss."""
    rounds: int = 40
    depth: int = 3
    rate: float = 0.2
    start: float = 0.0
    trees: list = field(default_factory=list)

    def fit(self, total, cuts: list) -> "Boost":
        """Grow the trees level by level. ``total(boost, tree, k)`` gives the sums
        (leaf, feature, code, [rows, gradient, hessian]) over the rows in the
        leaves 0 to k - 1 of ``tree``."""
        for _ in range(self.rounds):
            nodes, leaves = [0.0], [0]  # a node is its value, or feature, cut, left and right node
            for _ in range(self.depth):
                s = total(self, self._tree(nodes, 0, {i: float(k) for k, i in enumerate(leaves)}), len(leaves))
                below = []
                for i, sums in zip(leaves, s, strict=True):
                    n, g, h = sums[0].sum(0)
                    nodes[i] = float(g / (h + 1))
                    found = self._split(sums, cuts) if n >= 20 else None
                    if found:
                        j, t, sides = found
                        nodes[i] = (j, float(cuts[j][t]), len(nodes), len(nodes) + 1)
                        below += nodes[i][2:]
                        nodes += [float(side[1] / (side[2] + 1)) for side in sides]
                leaves = below
                if not leaves:
                    break
            self.trees.append(self._tree(nodes, 0))
        return self

    def _split(self, sums, cuts):
        """(feature, cut number, the sums of both sides) of the best split, or None."""
        left = sums.cumsum(1)[:, :CUTS]
        both = sums[0].sum(0)
        right = both - left
        gain = sum(x[..., 1] ** 2 / (x[..., 2] + 1) for x in (left, right)) - both[1] ** 2 / (both[2] + 1)
        there = np.arange(CUTS) < np.array([len(c) for c in cuts])[:, None]
        gain[~there | (left[..., 0] < 5) | (right[..., 0] < 5)] = 0
        j, t = np.unravel_index(gain.argmax(), gain.shape)
        return (int(j), int(t), (left[j, t], right[j, t])) if gain[j, t] > 1e-6 else None

    def _tree(self, nodes, i, leaves=None):
        """Nested tuples of node ``i``; with ``leaves``, the leaves' numbers (-1: none) instead of values."""
        if not isinstance(nodes[i], tuple):
            return nodes[i] if leaves is None else leaves.get(i, -1.0)
        j, t, a, b = nodes[i]
        return j, t, self._tree(nodes, a, leaves), self._tree(nodes, b, leaves)

    def _walk(self, tree, x) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        left = x[:, tree[0]] <= tree[1]
        out = np.empty(len(x))
        out[left], out[~left] = self._walk(tree[2], x[left]), self._walk(tree[3], x[~left])
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for t in self.trees:
            z += self.rate * self._walk(t, x)
        return 1 / (1 + np.exp(-z))


@dataclass
class Model:
    trees: Boost | None = None
    limits: dict = field(default_factory=dict)  # kind -> threshold; a kind without one gets no added spans


class _Counted:
    """Counted candidates of one kind of label each: codes (numbers of cuts
    below the features), labels and counts."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, cuts: list, start: float):
        self.codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, WIDTH).astype(np.int64)
        # the cut at or above a feature compares with every cut as the feature does
        upper = np.array([[*c, *[np.inf] * (CUTS + 1 - len(c))] for c in cuts])
        self.x = upper[np.arange(WIDTH), self.codes]
        self.y, self.n = (np.array(batch.column(c), float) for c in ("y", "n"))
        self.z, self.seen = np.full(len(self.y), start), 0

    def sums(self, boost: Boost, tree, k: int) -> np.ndarray:
        for t in boost.trees[self.seen:]:
            self.z += boost.rate * boost._walk(t, self.x)
        self.seen = len(boost.trees)
        q = 1 / (1 + np.exp(-self.z))
        at = boost._walk(tree, self.x).astype(np.int64)
        own = at >= 0
        what = [(self.n * v)[own] for v in (1.0, self.y - q, q * (1 - q))]
        out = np.empty((k, WIDTH, CUTS + 1, 3))
        for j in range(WIDTH):
            cell = at[own] * (CUTS + 1) + self.codes[own, j]
            for v, w in enumerate(what):
                out[:, j, :, v] = np.bincount(cell, w, k * (CUTS + 1)).reshape(k, -1)
        return out


def judged(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(held, kind, y, x) of every candidate of the whole texts that the base decides."""
    def run(batches):
        kept()
        for b in small(batches):
            held, y, x = [], [], []
            for own, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                more = sorted(set(candidates(t))) if t else []
                base = base_spans(t) if more else []
                spans = {k: [(a, z) for kind, a, z in base if kind == k] for k in KINDS}
                for k, a, z in more:
                    before = bisect_left(spans[k], (z,)) - 1  # spans of a kind lie apart: the last that starts before the end
                    cuts = before >= 0 and spans[k][before][1] > a
                    hit = cuts and spans[k][before] == (a, z)
                    if cuts or not valid(k, t[a:z]):
                        held.append(own)
                        y.append(int(hit))
                        x.append([float(v) for v in features(t, k, a, z)])
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.bool_()), pa.array([int(v[0]) for v in x], pa.int32()), pa.array(y, pa.int32()),
                                              pa.array(x, pa.list_(pa.float64()))], ["held", "kind", "y", "x"])

    return (docs.select((F.pmod(F.xxhash64(doc_id), F.lit(4)) == 0).alias("held"), F.col(text).alias("t"))
            .mapInArrow(run, "held boolean, kind int, y int, x array<double>"))


def _coded(found: DataFrame, cuts: list) -> DataFrame:
    """(held, kind, y, codes, n): the candidates counted by the codes of their features."""
    def run(batches):
        for b in batches:
            x = np.array(b.column("x").flatten(), float).reshape(-1, WIDTH)
            codes = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("held", "kind", "y")), pa.array([r.tobytes() for r in codes], pa.binary())],
                                             ["held", "kind", "y", "codes"])

    return (found.mapInArrow(run, "held boolean, kind int, y int, codes binary")
            .groupBy("held", "kind", "y", "codes").agg(F.count("*").alias("n")))


def fit(found: DataFrame, local_rows: int = LOCAL_ROWS) -> Model:
    """Model from all judged candidates."""
    spark = found.sparkSession
    own = F.when(~F.col("held"), F.col("y"))
    grid = F.array(*[F.lit(float(p)) for p in np.linspace(0.02, 0.98, CUTS)])
    cell = lambda j: F.when(~F.col("held"), F.col("x")[j])
    r = found.agg(F.count("*"), F.count(own), F.sum(own), *[F.percentile(cell(j), grid) for j in range(WIDTH)]).first()
    if r[0] < 40 or not r[1] or r[2] in (0, r[1]):
        return Model()
    cuts = [np.unique(c) for c in r[3:]]
    counted = materialize(_coded(found, cuts), "pii-counted")
    p = np.clip(r[2] / r[1], 1e-3, 1 - 1e-3)
    start = float(np.log(p / (1 - p)))
    rows = counted.where(~F.col("held")).select("codes", "y", "n")
    if is_small(rows, local_rows):
        total = _Counted(rows.orderBy("codes", "y").toArrow(), cuts, start).sums
    else:
        size = path_size(spark, counted.inputFiles()[0].rsplit("/", 1)[0])
        spread_rows = spread(rows, size)

        def total(boost, tree, k):
            def run(batches):
                out = np.zeros((k, WIDTH, CUTS + 1, 3))
                for b in batches:
                    out += _Counted(b, cuts, start).sums(boost, tree, k)
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])
            return sum(np.frombuffer(x.sums).reshape(k, WIDTH, CUTS + 1, 3) for x in spread_rows.mapInArrow(run, "sums binary").collect())

    m = Model(Boost(start=start).fit(total, cuts))

    def score(batches):
        for b in batches:
            c = _Counted(b, cuts, start)
            yield pa.RecordBatch.from_arrays([b.column("kind"), pa.array(m.trees.score(c.x), pa.float64()), b.column("n")], ["kind", "p", "n"])

    scored = counted.where("held and y = 1").mapInArrow(score, "kind int, p double, n long")
    for r in scored.groupBy("kind").agg(F.percentile("p", 1 - KEEP, F.col("n")).alias("low")).collect():
        m.limits[KINDS[r.kind]] = max(0.5, float(r.low))
    return m


def train(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Model:
    """Model from every whole text of ``docs``."""
    return fit(materialize(judged(docs, text, doc_id), "pii-candidates"))


def all_spans(text: str | None, model: Model) -> tuple[list, list]:
    """Base spans and all spans of a text, each by kind, then start."""
    if not text:
        return [], []
    base = base_spans(text)
    more = candidates(text) if model.trees is not None else []
    more = [c for c in more if c[0] in model.limits and not any(c[1] < z and a < c[2] for _, a, z in base)]
    out = list(base)
    if more:
        p = model.trees.score(np.array([features(text, *c) for c in more], float))
        for s, c in sorted(zip(p.tolist(), more, strict=True), key=lambda q: (-q[0], q[1][1] - q[1][2], q[1])):
            if s >= model.limits[c[0]] and valid(c[0], text[c[1]:c[2]]) and not any(c[1] < z and a < c[2] for _, a, z in out):
                out.append(c)
    order = lambda q: (KINDS.index(q[0]), q[1])
    return sorted(base, key=order), sorted(out, key=order)


def written(spans) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


def redacted(text: str, spans) -> str:
    """The text with every span replaced by its kind in angle brackets;
    overlapping spans become one replacement, named by the first."""
    out, at = [], 0
    for k, a, z in sorted(spans, key=lambda q: (q[1], -q[2])):
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, z)
    return "".join(out) + text[at:]


def find(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``base_spans`` and ``spans`` (strings kind:start:end, comma-joined)
    and ``redacted`` (the text without them; null stays null)."""
    schema = frame_schema(docs, "base_spans string, spans string, redacted string")
    names = [f.name for f in schema.fields]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        kept()
        m = shared.value
        for b in small(batches):
            base, spans, clean = [], [], []
            for t in b.column(text).to_pylist():
                x, y = all_spans(t, m)
                base.append(written(x))
                spans.append(written(y))
                clean.append(redacted(t, y) if y else t)
            new = {k: pa.array(v, pa.string()) for k, v in (("base_spans", base), ("spans", spans), ("redacted", clean))}
            yield pa.RecordBatch.from_arrays([new[n] if n in new else b.column(n) for n in names], names)

    return docs.mapInArrow(run, schema)


def op3_personal_data(spark, sf_dir: str) -> DataFrame:
    """Every whole text: counts and digest of the base spans, all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = find(docs, train(docs)).select("doc_id", "base_spans", "spans")
    count = lambda k: F.regexp_count("base_spans", F.lit(k + ":")).cast("long").alias(f"n_{k}")
    return got.select("doc_id", *map(count, KINDS), F.sha2("base_spans", 256).alias("base_sha256"), "spans")
