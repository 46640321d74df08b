"""Training-corpus pipeline: toxicity, near-duplicates, benchmark
contamination, personal data, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which ``run`` writes as Parquet to the shared folder
and reads back as the next stage's ``docs``. A stage works on every row its
predecessor kept; all but the last return the columns of ``documents``.

Decisions: ``toxicity`` drops rows scored ``REJECT`` or more by the model that
is fitted on the labelled rows of its input; ``near_dedup`` keeps one document
of each group of near-duplicates (0.8 of their ``SHINGLE``-word shingles), the
one with the smallest doc_id (of rows that repeat a doc_id the one whose text
has the smallest digest stays, whatever the layout of the files; rows without a
doc_id stay); ``decontaminate``
drops documents that hold a window of a benchmark item; ``redact`` replaces
personal data by its kind and sets n_chars anew; ``tokens`` encodes the text
and checks that the ids decode to the same bytes.

Null and empty texts are scored, belong to no group, hold no window and no
personal data, and encode to no ids; an empty table passes through; extra
columns of ``documents`` are kept up to the last stage, whatever their names.

Python gets every text once, in Arrow batches of ``BATCH_ROWS`` rows: ``run``
sets that for its own writes and puts the session's value back; a stage that
is called by itself leaves it set, as its frame is written later.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylag.llm import bpe, decontam, hyperminhash, pii, toxicity
from skylag.llm.common import sized_broadcast, table
from skylag.session import materialize

SHINGLE = 5  # words; op2_hyperminhash alone has two
BATCH_ROWS = "1000"
PIECES = 120_000  # remembered by a worker of the last stage
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"

ORACLE_SQL = None  # models and tokenizers are beyond SQL: tests/llm compares with brute force


def _slim(docs: DataFrame) -> DataFrame:
    """The text, once, and all else in one struct, so that no name can clash."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text")


def _whole(rows: DataFrame, docs: DataFrame, **new) -> DataFrame:
    """The columns of ``docs`` again, ``new`` in the place of some."""
    return rows.select(*[new.get(c, F.col("text") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(_slim(docs), model, out="score")
    return _whole(scored.where(F.col("score") < toxicity.REJECT), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"))
    gone = (hyperminhash.near_duplicates(docs.select("doc_id", "text"), shingle=SHINGLE).where("not kept and doc_id is not null")
            .select(F.col("doc_id").alias("other")).distinct())
    same = F.col("id") == F.col("other")
    left = rows.join(sized_broadcast(gone), same, "left_anti")
    twice = sized_broadcast(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("other")).agg(F.count("*").alias("n"))
                            .where("n > 1").select("other"))
    first = F.min_by("row", F.struct(F.sha2("row.text", 256), F.to_json("row"))).alias("row")
    return (left.join(twice, same, "left_anti").select("row")
            .unionByName(left.join(twice, same, "left_semi").groupBy("id").agg(first).select("row")).select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.find(_slim(docs), table(spark, sf_dir, "benchmark"))
    return _whole(found.where(F.octet_length("spans") == 0), docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pii.find(_slim(docs), pii.train(docs))
    return _whole(found, docs, text=F.col("redacted"), n_chars=F.coalesce(F.length("redacted"), F.lit(0)).cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    code = bpe.vocabulary_json(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode_checked(docs.select("doc_id", "lang", "source", "text"), code, pieces=PIECES)


def _short_batches(stage):
    """The stage with short Arrow batches: whole documents are long."""
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(_BATCH_KEY, BATCH_ROWS)
        return stage(spark, docs, sf_dir)
    run.__name__, run.__doc__ = stage.__name__, stage.__doc__
    return run


STAGES = [(name, _short_batches(stage)) for name, stage in (
    ("toxicity", toxic), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("redact", redact), ("tokens", tokens))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result is (doc_id, lang, source, ids,
    n_tokens, round_trip) of every document that is left."""
    before = spark.conf.get(_BATCH_KEY)
    docs = table(spark, sf_dir, "documents")
    try:
        for name, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    finally:
        spark.conf.set(_BATCH_KEY, before)
    return docs
