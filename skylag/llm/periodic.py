"""Periodic runs of words: scale-tiled search with boundary Z-functions.

A run is a maximal stretch of words with smallest period q, at least
``MIN_WORDS`` and three periods long. For the periods of one octave
[step/2, step) a document is cut into overlapping tiles around boundaries
``step`` words apart (the first octave holds the periods 1 to 15). A tile sees
``step`` words before its boundary b and two after it. Two Z-functions give
for all periods of the octave at once how far w[i] = w[i + q] holds to the
right of b and to the left; where that reaches over ``step`` words, the tile
emits the fragment (q, first i, end of i). Every run holds a boundary of its
octave, and each tile whose boundary it holds sees that much of it, so nothing
is lost; tiles at whose boundary no eight words repeat within ``step`` can
hold no such fragment and are skipped. A block of q words that is itself a
repetition has a smaller period and is left out on the spot.

Fragments are shuffled by (document, period), and those that touch are
stitched to runs: equality at i is a matter of single words, so touching
intervals add up exactly.

Scale: a document of up to ``LONG_BYTES`` is tiled where it is read. A longer
one is cut into groups of tiles, each with the word numbers that it needs, dealt to
all tasks and solved there. Only fragments are shuffled (O(n) of them, however
repetitive a text is), and only documents with fragments are written and read
again to drop words.

Defined results: words are separated by ASCII white space; a null, empty or
wordless text has no words, no runs and collapses to the empty text; rows that
repeat an id, or have none, are documents of their own; of runs with equal
exponent the first, then the one of smallest period is the best; an empty
table gives no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import small, table

MIN_WORDS, FIRST_STEP = 24, 16
GRAM = FIRST_STEP // 2
LONG_BYTES = 1 << 20
GROUP_WORDS = 1 << 16


def _z(s: list) -> list:
    """z[i]: length of the longest common prefix of s and s[i:]."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = z[i - left] if i < right else 0
        if i + k >= right:
            k = max(0, right - i)
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def _primes(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return out + [q] * (q > 1)


def solve_tile(words: list, b: int, step: int) -> list[tuple[int, int, int]]:
    """Fragments (q, start, end) of w[i] = w[i + q] around boundary ``b``, for
    the primitive periods q of the octave below ``step``."""
    n, low = len(words), 1 if step == FIRST_STEP else step // 2
    ahead = words[b:b + 2 * step]
    right = _z(ahead)
    back = words[max(0, b - step):b][::-1]
    end = min(n, b + step)
    left = _z(back + [None] + words[max(0, b - step):end][::-1])
    out = []
    for q in range(low, min(step, n - b)):
        r = min(right[q], step) if q < len(ahead) else 0
        k = left[len(back) + 1 + end - b - q] if b + q <= end else 0
        if r + k >= step and not any(right[q // p] >= q - q // p for p in _primes(q)):
            out.append((q, b - k, b + r))
    return out


def _stitch(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    for q, s, e in sorted(found):
        if out and out[-1][0] == q and s <= out[-1][2]:
            out[-1] = (q, out[-1][1], max(e, out[-1][2]))
        else:
            out.append((q, s, e))
    return out


def _next_gram(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Distance to the next place in the same document where the same GRAM
    words begin (by hash: too many are found, never too few); 2^62 if none."""
    n = len(codes)
    far = np.full(n, 1 << 62, np.int64)
    if n <= GRAM:
        return far
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    grams = np.zeros(n - GRAM + 1, np.uint64)
    for j in range(GRAM):
        grams = grams * np.uint64(0xBF58476D1CE4E5B9) + mixed[j:n - GRAM + 1 + j]
    order = np.argsort(grams, kind="stable")
    same = (grams[order[1:]] == grams[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    far[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return far


def _steps(n: int) -> list[int]:
    """Tile steps of the octaves that a document of n words can have runs in."""
    out, step = [], FIRST_STEP
    while n >= MIN_WORDS and (step == FIRST_STEP or 3 * (step // 2) <= n):
        out.append(step)
        step *= 2
    return out


def _active(far: np.ndarray, step: int, first: int, last: int) -> list[int]:
    """Boundaries in [first, last) that some eight words before or behind repeat within ``step``."""
    b = np.arange(first, last, step)
    behind = np.where(b >= GRAM, far[np.maximum(b - GRAM, 0)], 1 << 62)
    return b[(far[b] < step) | (behind < step)].tolist()


def solve(words: list, far: np.ndarray, step: int, first: int = 0, last: int | None = None) -> list[tuple[int, int, int]]:
    """Stitched fragments of the tiles of one octave with boundaries in [first, last)."""
    found: list = []
    for b in _active(far, step, first, len(words) if last is None else last):
        found += solve_tile(words, b, step)
    return _stitch(found)


def altered(key: int | None, n: int) -> tuple[int, int] | None:
    """The query contract's rule: (a, p) if words from a on repeat with period p."""
    if key is None or not n:
        return None
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _words(text: str | None, key, rule) -> list[bytes]:
    ws = text.encode().split() if text else []
    change = rule(key, len(ws)) if rule else None
    if change:
        a, p = change
        ws = ws[:a] + [ws[i] for i in (a + np.arange(len(ws) - a) % p).tolist()]
    return ws


_FRAGS = "frags array<struct<q:long,s:long,e:long>>"
_FRAG_TYPE = pa.list_(pa.struct([("q", pa.int64()), ("s", pa.int64()), ("e", pa.int64())]))


def _frag_array(rows):
    return pa.array([None if r is None else [{"q": q, "s": s, "e": e} for q, s, e in r] for r in rows], _FRAG_TYPE)


def _reader(rule, long_bytes: int):
    """Tiles of the documents read; words (joined by one space) only of those
    that have fragments or are long, whose fragments are null."""
    def run(batches):
        for b in small(batches):
            ids = b.column("id").to_pylist()
            docs = [_words(t, k, rule) for t, k in zip(b.column("text").to_pylist(), ids, strict=True)]
            joined = [b" ".join(ws) for ws in docs]
            number: dict = {}
            codes = [number.setdefault(w, len(number)) for ws in docs for w in ws]
            sizes = np.array([len(ws) for ws in docs])
            begin = np.concatenate([[0], np.cumsum(sizes)])
            far = _next_gram(np.array(codes, np.int64), np.repeat(np.arange(len(docs)), sizes))
            frags: list = []
            for i, n in enumerate(sizes.tolist()):
                if len(joined[i]) > long_bytes:
                    frags.append(None)
                    continue
                at = slice(begin[i], begin[i] + n)
                own, gaps, found = None, far[at], []
                for step in _steps(n) if n and gaps.min() < n else ():
                    own = own or codes[at]
                    found += solve(own, gaps, step)
                frags.append([f for f in found if f[2] - f[1] + f[0] >= max(MIN_WORDS, 3 * f[0])])
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("id"), pa.array(sizes, pa.int64()), _frag_array(frags),
                 pa.array([None if f == [] else j.decode() for f, j in zip(frags, joined, strict=True)], pa.string()),
                 pa.array([hashlib.sha256(j).hexdigest() if f == [] else None for f, j in zip(frags, joined, strict=True)], pa.string())],
                ["row", "id", "n", "frags", "words", "collapsed_sha256"])
    return run


def _cutter(group_words: int):
    """Long documents -> groups of tiles: word numbers from ``base`` on, for
    the boundaries in [first, last)."""
    names = ["row", "step", "base", "first", "last", "codes"]

    def run(batches):
        for b in small(batches):
            for row, words in zip(b.column("row").to_pylist(), b.column("words").to_pylist(), strict=True):
                number: dict = {}
                codes = np.array([number.setdefault(w, len(number)) for w in words.split(" ")], "<i4")
                n = len(codes)
                for step in _steps(n):
                    wide = step * max(1, group_words // step)
                    for first in range(0, n, wide):
                        base, last = max(0, first - step), min(n, first + wide)
                        part = codes[base:last + 2 * step]
                        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (row, step, base, first, last)]
                                                         + [pa.array([part.tobytes()], pa.binary())], names)
    return run


def _tile_solver(batches):
    for b in small(batches):
        for r in b.to_pylist():
            part, base = np.frombuffer(r["codes"], "<i4"), r["base"]
            found = solve(part.tolist(), _next_gram(part, np.zeros(len(part), np.int8)), r["step"], r["first"] - base, r["last"] - base)
            cols = [pa.array([r["row"]] * len(found), pa.int64())] + [pa.array(x, pa.int64()) for x in (
                [f[0] for f in found], [f[1] + base for f in found], [f[2] + base for f in found])]
            yield pa.RecordBatch.from_arrays(cols, ["row", "q", "s", "e"])


def stitched(fragments: DataFrame) -> DataFrame:
    """Runs (row, q, start, length) from fragments (row, q, s, e) of any tiles."""
    key = Window.partitionBy("row", "q").orderBy("s", "e")
    before = F.max("e").over(key.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(before >= F.col("s"), 0).otherwise(1)).over(key.rowsBetween(Window.unboundedPreceding, 0))
    return (fragments.withColumn("island", island).groupBy("row", "q", "island").agg(F.min("s").alias("start"), F.max("e").alias("e"))
            .select("row", "q", "start", (F.col("e") - F.col("start") + F.col("q")).alias("length"))
            .where((F.col("length") >= MIN_WORDS) & (F.col("length") >= 3 * F.col("q"))))


def find_runs(docs: DataFrame, text: str = "text", id: str = "doc_id", rule=None, long_bytes: int = LONG_BYTES,
              group_words: int = GROUP_WORDS) -> DataFrame:
    """One row per row of ``docs``: (id, n, words, runs, collapsed_sha256).
    ``runs`` is sorted by start and period; ``words`` (joined by one space) and
    no digest where the row may have runs, else the digest of all its words.
    ``rule(id, n)`` may give (a, p): words from a on repeat with period p."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.col(text).alias("text"))
    read = materialize(rows.mapInArrow(_reader(rule, long_bytes), rows.select("row", "id").schema.simpleString()[7:-1].replace(":", " ")
                                       + f", n long, {_FRAGS}, words string, collapsed_sha256 string"), "tiles")
    short = read.where("size(frags) > 0").select("row", F.explode("frags").alias("f")).select("row", "f.*")
    tiles = (read.where("frags is null and words is not null").select("row", "words")
             .mapInArrow(_cutter(group_words), "row long, step long, base long, first long, last long, codes binary")
             .repartition("row", "step", "first"))
    fragments = short.unionByName(tiles.mapInArrow(_tile_solver, "row long, q long, s long, e long"))
    runs = stitched(fragments).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "q", "length"))).alias("runs"))
    none = F.array().cast("array<struct<start:bigint,q:bigint,length:bigint>>")
    some = (read.where("words is not null").join(runs, "row", "left")
            .select("id", "n", "words", F.coalesce("runs", none).alias("runs"), "collapsed_sha256"))
    return some.unionByName(read.where("words is null").select("id", "n", "words", none.alias("runs"), "collapsed_sha256"))


def collapse(words: list, runs: list[dict]) -> list:
    """The words without those that a run holds after its first period."""
    drop = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        drop[r["start"] + r["q"]] += 1
        drop[r["start"] + r["length"]] -= 1
    return [w for w, d in zip(words, np.cumsum(drop[:-1]).tolist(), strict=True) if not d]


def best(runs: list[dict]) -> dict | None:
    """The run of greatest length / period; ties: smallest start, then period."""
    top = None
    for r in runs:  # sorted by start and period
        if top is None or r["length"] * top["q"] > top["length"] * r["q"]:
            top = r
    return top


def _digests(batches):
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    for b in small(batches):
        tops, listed, collapsed = [], [], []
        runs = b.column("runs").to_pylist()
        for words, own, digest in zip(b.column("words").to_pylist(), runs, b.column("collapsed_sha256").to_pylist(), strict=True):
            tops.append(best(own))
            listed.append(hashlib.sha256("".join(f"{r['start']},{r['length']},{r['q']}\n" for r in own).encode()).hexdigest())
            if digest is None:
                digest = hashlib.sha256(" ".join(collapse(words.split(" ") if words else [], own)).encode()).hexdigest()
            collapsed.append(digest)
        get = lambda f: pa.array([None if t is None else f(t) for t in tops], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), pa.array([len(r) for r in runs], pa.int64()), get(lambda t: t["start"]), get(lambda t: t["length"]),
             get(lambda t: t["q"]), get(lambda t: 1000 * t["length"] // t["q"]), pa.array(listed), pa.array(collapsed)], names)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """All documents, whole texts, with the contract's altered words."""
    found = find_runs(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rule=altered)
    return found.mapInArrow(_digests, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
                                      "runs_sha256 string, collapsed_sha256 string")
