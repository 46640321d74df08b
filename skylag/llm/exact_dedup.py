"""Exact duplicates in two Bloom-filter passes, native functions only.

Every text is reduced to its SHA-256; a 64-bit hash of that gives the row a
word of a filter and two bits in it. The first pass counts the rows of each
(word, bits) - eight bytes a row, combined before they move - and keeps those
met twice or more: a Bloom filter of the possibly repeated hashes, as (word,
bits) rows. The second pass holds every row against that filter. A row whose
bits are not all set has no equal and passes straight through, without a
shuffle; only the rest is grouped by digest. The number of words follows the
number of rows (``ROWS_PER_WORD``), so about one unique row in a thousand is
grouped in vain at every size.

Scale: the filter is broadcast while it has at most ``FILTER_WORDS`` rows (a
checked bound of some 64 MB); beyond it the 40-byte digest rows meet it in a
shuffled join, with the same result. Groups that hold more than 1/4096 of the
candidates (4,096 at most, so a proven bound) are joined by broadcast, so that
a text with a third of all rows never lands in one task; group sizes and the
row that stays are aggregated before the shuffle.

Defined results: null counts as the empty text; texts are compared as they
are, byte for byte; of equal texts the row with the largest id stays, a null
id counting as the smallest; if that id repeats, exactly one of its rows
stays; an empty table gives no rows; other columns are kept by
``deduplicate`` and left out by ``find_duplicates``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import table

ROWS_PER_WORD = 2
FILTER_WORDS = 1_600_000
HOT_PARTS = 4096


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def _slots(rows: DataFrame, bits: int) -> DataFrame:
    """``rows`` with the filter word (of 2^bits) and the two bits of ``digest``."""
    h = F.xxhash64("digest")
    first, second = h.bitwiseAND(63), F.shiftrightunsigned(h, 6).bitwiseAND(63)
    one = F.lit(1).cast("long")
    mask = F.call_function("shiftleft", one, first.cast("int")).bitwiseOR(
        F.call_function("shiftleft", one, second.cast("int")))
    return rows.withColumns({"word": F.shiftrightunsigned(h, 64 - bits), "mask": mask})


def _word_bits(rows: int) -> int:
    return max(1, (rows // ROWS_PER_WORD).bit_length())


def repeated_filter(digests: DataFrame, bits: int) -> DataFrame:
    """First pass: (f_word, f_bits) of the slots that two rows or more have."""
    return (_slots(digests, bits).groupBy("word", "mask").count().where("count > 1")
            .groupBy(F.col("word").alias("f_word")).agg(F.bit_or("mask").alias("f_bits")))


def _probe(rows: DataFrame, bits: int, found: DataFrame, filter_words: int) -> DataFrame:
    """Second pass: ``rows`` with the boolean ``maybe``."""
    small = found.limit(filter_words + 1).count() <= filter_words
    met = _slots(rows, bits).join(F.broadcast(found) if small else found, F.col("word") == F.col("f_word"), "left")
    maybe = F.coalesce(F.col("f_bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))
    return met.withColumn("maybe", maybe).drop("word", "mask", "f_word", "f_bits")


def find_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", filter_words: int = FILTER_WORDS) -> DataFrame:
    """One row per row of ``docs``: (id, keep_id, group_size, kept, text_sha256)."""
    rows = materialize(docs.select(F.col(id).alias("id"), F.monotonically_increasing_id().alias("row"), _digest(text).alias("digest")),
                       "digests")
    bits = _word_bits(rows.count())
    found = materialize(repeated_filter(rows, bits), "repeated")
    probed = _probe(rows, bits, found, filter_words)
    alone = probed.where(~F.col("maybe"))
    some = materialize(probed.where("maybe").drop("maybe"), "maybe-repeated")

    groups = materialize(some.groupBy(F.col("digest").alias("g")).agg(
        F.count("*").alias("group_size"), F.max(F.struct("id", "row")).alias("top")), "groups")
    hot = F.broadcast(groups.where(F.col("group_size") > some.count() // HOT_PARTS + 1))
    same = F.col("digest") == F.col("g")
    grouped = some.join(hot, same).unionByName(
        some.join(hot, same, "left_anti").join(groups.where(F.col("group_size") <= some.count() // HOT_PARTS + 1), same))
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    return (alone.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
            .unionByName(grouped.select("id", F.col("top.id").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"), sha)))


def deduplicate(docs: DataFrame, text: str = "text", id: str = "doc_id", filter_words: int = FILTER_WORDS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows without an
    equal are not shuffled; of a possibly repeated text one row a task moves."""
    digests = docs.select(_digest(text).alias("digest"))
    bits = _word_bits(docs.count())
    found = materialize(repeated_filter(digests, bits), "repeated")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id).alias("id"), _digest(text).alias("digest"))
    probed = _probe(rows, bits, found, filter_words)
    # rows that tie on the id differ in other columns only: the order of their JSON form decides
    best = (probed.where("maybe").withColumn("tie", F.to_json("doc")).groupBy("digest")
            .agg(F.max_by("doc", F.struct("id", "tie")).alias("doc")))
    return probed.where(~F.col("maybe")).select("doc.*").unionByName(best.select("doc.*"))


def op13_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents; the row with the largest doc_id of each text stays."""
    return find_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
