"""Source divergence audit: which sources of a language differ, and by which terms.

A term is a run of letters and non-ASCII characters, only A-Z lower-cased; a
language keeps the terms in at least ``MIN_DOCS`` of its documents. Counting
is done in numpy, a slice of texts at a time: the terms are found as byte runs
of one buffer and dealt into buckets by length. Up to 8 bytes a term is one
uint64 word, up to 16 two of them; a bucket is radix-sorted (16 bits a pass,
as many passes as its length needs) and its runs are counted. Longer terms go
to a bucket per length that is sorted by bytes. Texts are laid out by group
first and all sorts are stable, so a run falls into groups and documents
without another sort, and one scan gives occurrences and documents.

Scale: slices are bounded in bytes, their counts are combined before the
shuffle, so frequent terms and a source with a third of all rows meet as
partial sums. Pairs of sources are compared term block by term block: a task
has ``BLOCK_CELLS`` (terms x sources) numbers and ``ROW_SOURCES`` sources
against all, and returns sums only; no term emits its pairs. The result itself
holds every pair of sources of a language. All arithmetic is exact integers.

Defined results: null text, lang and source count as ''; empty texts have no
terms but their group occurs; repeated rows count as documents of their own; a
language without kept terms gives pairs of value 0 and no terms; equal values
rank by the item's UTF-8 bytes; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import sized_broadcast, small, table

MIN_DOCS, TOP = 10, 10
SLICE_BYTES = 8 << 20
BLOCK_CELLS = 250_000
ROW_SOURCES = 256

_FOLD = np.array([c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0 for c in range(256)], np.uint8)


def _radix_order(words: list[np.ndarray], digits: int) -> np.ndarray:
    """Stable order by the top ``digits`` 16-bit digits of the words (most
    significant word first), least significant digit first."""
    order = None
    for d in reversed(range(digits)):
        digit = (words[d // 4] >> np.uint64(48 - 16 * (d % 4))).astype(np.uint16)
        if order is None:
            order = np.argsort(digit, kind="stable")
        else:
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def _buckets(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray):
    """Per length bucket: occurrences in sorted order, and where a new term begins."""
    eight = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))  # the 8 bytes from every position on

    def word(at, size):
        cut = np.clip(8 - size, 0, 7).astype(np.uint64) * np.uint64(8)
        return (eight[at].byteswap() >> cut) << cut

    for digits in range(1, 9):
        own = np.flatnonzero((lens == 2 * digits) | (lens == 2 * digits - 1))
        if len(own):
            at, size = starts[own], lens[own]
            words = [word(at, size)] + ([word(at + 8, size - 8)] if digits > 4 else [])
            order = _radix_order(words, digits)
            new = np.ones(len(own), bool)
            new[1:] = False
            for w in words:
                w = w[order]
                new[1:] |= w[1:] != w[:-1]
            yield own[order], new
    for size in np.unique(lens[lens > 16]):
        own = np.flatnonzero(lens == size)
        rows = buf[starts[own][:, None] + np.arange(size)].view(f"S{size}").ravel()
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        new = np.ones(len(own), bool)
        new[1:] = rows[1:] != rows[:-1]
        yield own[order], new


def count_terms(texts: pa.Array, group: np.ndarray):
    """Occurrences and documents of each (group, term); ``group`` is ascending.
    Returns (groups, terms as a string array, occurrences, documents)."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    size = int(offsets[-1] - offsets[0])
    buf = np.zeros(size + 16, np.uint8)
    if size:
        buf[:size] = _FOLD[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]]
    offsets = offsets - offsets[0]
    inside = buf[:size] != 0
    edge = offsets[:-1][np.diff(offsets) > 0]  # where a text begins, no term goes on
    before, after = np.zeros(size, bool), np.zeros(size, bool)
    before[1:] = inside[:-1]
    before[edge] = False
    after[:-1] = inside[1:]
    after[edge[1:] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    lens = np.flatnonzero(inside & ~after) + 1 - starts
    doc = np.searchsorted(offsets, starts, side="right") - 1
    out = []
    for own, new in _buckets(buf, starts, lens):
        d = doc[own]
        g = group[d]
        run, docs = new.copy(), new
        run[1:] |= g[1:] != g[:-1]
        docs[1:] |= d[1:] != d[:-1]
        at = np.flatnonzero(run)
        out.append((own[at], g[at], np.diff(np.append(at, len(own))), np.add.reduceat(docs.astype(np.int64), at)))
    first, groups, n, docs = (np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out) if out else [()] * 4))
    sizes = lens[first] if out else first
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    data = buf[np.repeat(starts[first] - ends[:-1], sizes) + np.arange(ends[-1])] if out else buf[:0]
    terms = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
    return groups, terms.cast(pa.string()), n, docs


def _counter(batches):
    for b in small(batches, SLICE_BYTES):
        pairs = list(zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True))
        names = sorted(set(pairs))
        code = {p: i for i, p in enumerate(names)}
        group = np.array([code[p] for p in pairs], np.int64)
        order = np.argsort(group, kind="stable")
        groups, terms, n, docs = count_terms(b.column("text").cast(pa.large_string()).take(pa.array(order)), group[order])
        if len(groups):
            langs, sources = (pa.array([p[k] for p in names]).take(pa.array(groups)) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([langs, sources, terms, pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
                                             ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term."""
    return (docs.mapInArrow(_counter, "lang string, source string, term string, n long, docs long")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def _share(count: str):
    """The smoothed share of a count, in parts of 10^9, exact at any count."""
    return F.expr(f"1 + (cast(1000000000 as decimal(10,0)) * cast({count} + 2 as decimal(20,0))) div cast(total + 2 * v as decimal(20,0))")


_GAP = "((p - q) * (p - q)) div (p + q)"


def _compare(key, cells: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of the gaps over a block's terms: sources of one part against all."""
    names = groups.column("source").to_pylist()
    place = {s: i for i, s in enumerate(names)}
    absent = np.array(groups.column("absent").to_pylist(), np.int64)
    terms = cells.column("term").combine_chunks().dictionary_encode()
    shares = np.repeat(absent[None, :], len(terms.dictionary), axis=0)
    if cells.num_rows:
        column = np.array([place[s] for s in cells.column("source").to_pylist()])
        shares[terms.indices.to_numpy(), column] = cells.column("p").to_numpy()
    rows = [i for i, part in enumerate(groups.column("part_of").to_pylist()) if part == key[2].as_py()]
    values = []
    for i in rows:
        p = shares[:, i:i + 1]
        values.append(((shares - p) ** 2 // (shares + p)).sum(axis=0, dtype=np.int64))
    at = [(i, j) for i in rows for j in range(len(names))]
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    keep = [k for k, (i, j) in enumerate(at) if i != j]
    return pa.table({"lang": pa.array([key[0].as_py()] * len(keep), pa.string()), "source": pa.array([names[at[k][0]] for k in keep], pa.string()),
                     "item": pa.array([names[at[k][1]] for k in keep], pa.string()), "value": pa.array(flat[keep], pa.int64())})


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows rank the other
    sources of the language by divergence, ``term`` rows the terms by which a
    source stands out from its language."""
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    every = materialize(term_counts(docs), "terms")
    kept = materialize(every.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
                       .where(F.col("docs") >= min_docs).drop("docs"), "kept-terms")
    cells = every.drop("docs").join(kept, ["lang", "term"])
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = (docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
              .na.fill(0, ["total", "v", "lang_total"]))
    by_lang = Window.partitionBy("lang")
    groups = materialize(
        groups.withColumn("at", F.row_number().over(by_lang.orderBy("source")) - 1)
        .withColumn("sources", F.count("*").over(by_lang))
        .withColumn("part_of", F.floor(F.col("at") / ROW_SOURCES).cast("int"))
        .withColumn("parts", F.ceil(F.col("sources") / ROW_SOURCES).cast("int"))
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") * F.col("sources") / BLOCK_CELLS)).cast("int"))
        .withColumn("absent", F.when(F.col("v") > 0, _share("0")).otherwise(0)), "groups")
    cells = materialize(cells.join(sized_broadcast(groups.select("lang", "source", "total", "v", "lang_total", "blocks", "parts")), ["lang", "source"])
                        .withColumn("p", _share("n")).withColumn("total", F.col("lang_total")).withColumn("q", _share("lang_n"))
                        .select("lang", "source", "term", "p", "q", "parts", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block")), "cells")

    ranked = lambda rows, item: rows.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", "source").orderBy(F.desc("value"), item)))
    terms = (ranked(cells.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_GAP).alias("value")), "item")
             .where(F.col("rank") <= top))

    key = ["lang", "block", "part"]
    left = cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*key, "source", "term", "p")
    right = (groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*key, "source", "absent", "part_of"))
    sums = (left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_compare, "lang string, source string, item string, value long")
            .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    columns = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(ranked(sums, "item"), "pair").unionByName(columns(terms, "term"))


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    """All documents, every language and source."""
    return audit(table(spark, sf_dir, "documents"))


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
occ AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM occ GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
cnt AS (SELECT o.lang, o.source, o.term, count(*)::HUGEINT AS n FROM occ o JOIN kept k ON k.lang = o.lang AND k.term = o.term GROUP BY ALL),
tot AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM cnt GROUP BY ALL),
grp AS (SELECT g.lang, g.source, coalesce(t.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) g
        LEFT JOIN tot t ON t.lang = g.lang AND t.source = g.source),
share AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (g.total + 2 * l.v) AS p,
                 1 + (1000000000 * (k.n + 2)) // (l.total + 2 * l.v) AS q
          FROM grp g JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang
          LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
gaps AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
         FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(g.value, 0)::BIGINT AS value
          FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN gaps g ON g.lang = a.lang AND g.source = a.source AND g.item = b.source),
terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM share WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
