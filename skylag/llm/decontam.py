"""Benchmark decontamination: Wu-Manber search over words.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
A test item's windows (``width`` consecutive words; a shorter item is one
window) are the patterns, grouped by length. For a group of length m, blocks
of two words (one, if m is 1) index a shift table: how far the search may
jump when that block ends at the current word. Where the shift is 0, the
block's bucket names the patterns that end with it, and a direct comparison
of all words confirms an occurrence.

The benchmark is a stated query set: it is cut into blocks of at most
``BLOCK_BYTES`` of text (an item is never split), each broadcast on its own,
and every document is searched for each block in turn; with more than one
block the result so far is written to the shared folder in between.

Defined results: a null or wordless text has no words and no hits; a null or
wordless item has no windows; an item with a null id counts under the empty
string; repeated item ids count once; repeated documents get a row each;
empty tables give no rows or no hits; other columns are kept (a column with
the name of an output column is replaced).
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import frame_schema, kept, small, table

WIDTH = 10
BLOCK_BYTES = 8 << 20
_CLEAN = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20
               for c in range(256))


def _words(text: str | None) -> list[bytes]:
    return text.encode().translate(_CLEAN).split() if text else []


class WuManber:
    """Patterns (word tuples) -> items, searched group by group of length."""

    def __init__(self, items: list[tuple[str, str | None]], width: int = WIDTH):
        self.vocab: dict[bytes, int] = {}
        groups: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            ws = [self.vocab.setdefault(w, len(self.vocab)) for w in _words(text)]
            m = min(width, len(ws))
            for i in range(len(ws) - m + 1 if m else 0):
                groups.setdefault(m, {}).setdefault(tuple(ws[i:i + m]), set()).add(item)
        self.n = max(1, len(self.vocab))
        self.groups = [self._tables(m, p) for m, p in sorted(groups.items())]

    def _tables(self, m: int, patterns: dict[tuple, set]):
        block = min(2, m)
        shift: dict[int, int] = {}
        buckets: dict[int, dict[tuple, set]] = {}
        last = m - block
        for p, items in patterns.items():
            for j in range(last + 1):
                k = self._key(p[j:j + block])
                if last - j < shift.get(k, last + 1):
                    shift[k] = last - j
            buckets.setdefault(self._key(p[last:]), {})[p] = items
        return m, block, shift, buckets

    def _key(self, block) -> int:
        return block[0] if len(block) == 1 else block[0] * self.n + block[1]

    def search(self, ids: list) -> tuple[list[tuple[int, int]], set]:
        """ids: vocabulary numbers, None for other words. Occurrences as
        (start, length) and the items found."""
        found, hits, size, n = set(), [], len(ids), self.n
        for m, block, shift, buckets in self.groups:
            jump, i = m - block + 1, m - 1
            while i < size:
                b = ids[i]
                if b is None:  # no window reaches over this word
                    i += m
                    continue
                if block == 2:
                    a = ids[i - 1]
                    if a is None:
                        i += m - 1
                        continue
                    b += a * n
                s = shift.get(b, jump)
                if s:
                    i += s
                    continue
                items = buckets[b].get(tuple(ids[i - m + 1:i + 1]))
                if items is not None:
                    hits.append((i - m + 1, m))
                    found |= items
                i += 1
        return hits, found


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> list[DataFrame]:
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // block_bytes))
    return [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds ``n_words``, ``spans`` (binary: int32 pairs of first word and
    length of the hit runs, merged) and ``items`` (found item ids, sorted)."""
    spark = docs.sparkSession
    schema = frame_schema(docs, "n_words long, spans binary, items array<string>")
    names = [f.name for f in schema.fields]
    blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    out = docs
    for k, block in enumerate(blocks):
        tables = spark.sparkContext.broadcast([(r.item, r.text) for r in block.collect()])
        out = out.mapInArrow(_searcher(tables, text, width, names, k > 0), schema)
        if len(blocks) > 1:
            out = materialize(out, "decontam")
            tables.unpersist()
    return out


def _searcher(tables, text: str, width: int, names: list[str], more: bool):
    key = uuid.uuid4().hex

    def run(batches):
        wm = kept(("decontam", key), lambda: WuManber(tables.value, width))
        number = wm.vocab.get
        for b in small(batches):
            counts, spans, items = [], [], []
            old = zip(b.column("spans").to_pylist(), b.column("items").to_pylist(), strict=True) if more else None
            for t in b.column(text).to_pylist():
                ws = _words(t)
                hits, found = wm.search(list(map(number, ws)))
                if old is not None:
                    was, names_ = next(old)
                    hits += map(tuple, np.frombuffer(was, "<i4").reshape(-1, 2).tolist())
                    found |= set(names_)
                counts.append(len(ws))
                spans.append(_merged(hits))
                items.append(sorted(found))
            new = {"n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, pa.binary()),
                   "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new[n] if n in new else b.column(n) for n in names], names)
    return run


def _merged(hits) -> bytes:
    out: list[list[int]] = []
    for a, k in sorted(hits):
        if out and a <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], a + k - out[-1][0])
        else:
            out.append([a, k])
    return np.array(out, "<i4").tobytes()


def hit_words(spans: bytes) -> int:
    return int(np.frombuffer(spans, "<i4")[1::2].sum())


def verdicts(found: DataFrame) -> DataFrame:
    """Per document counts and digest of ``find``'s columns."""
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string"

    def run(batches):
        for b in small(batches):
            items = b.column("items").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_words"),
                 pa.array([hit_words(s) for s in b.column("spans").to_pylist()], pa.int64()),
                 pa.array([len(x) for x in items], pa.int64()),
                 pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items])],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])

    return (found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "spans", "items").mapInArrow(run, schema)
            .withColumn("contaminated", F.col("n_hit") > 0))


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against all windows of the benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return verdicts(find(docs, table(spark, sf_dir, "benchmark")).drop("text"))
