"""Token counts as delta-maintained roll-ups.

A store is a folder with, per attempt of a batch,
  ``batches/<batch>/<attempt>/ledger``  the rows the batch sets or removes
  ``batches/<batch>/<attempt>/delta``   its signed additive totals
and ``commits/<batch>``, a one-row Parquet table naming the attempt and the
batch's place in the order; the folder is made by one rename, so a batch is
committed once or not at all, and committing it again changes nothing. That
needs a store whose rename is one step (HDFS, shared disks; not a plain object
store). A store has one writer at a time.

A batch has rows (op, doc_id, source, lang, n_tokens) of one tokenizer version:
  ``insert``  adds a document (a doc_id that is present is ignored),
  ``revise``  replaces the counts of a present document (else ignored),
  ``delete``  removes a present document (else ignored).
Several rows of one document in a batch act one after the other in the order
delete, insert, revise, and only their net effect is signed: a delete with an
insert replaces a document, an insert with a revise adds it as revised.
Signed deltas follow from the ledger: -1 times what the document counted so
far, +1 times what it counts now. Totals are the sums of the committed
batches' deltas; the documents are never counted again.

Defined results: null source, lang or doc_id are values like others (null
doc_ids are one document); null n_tokens count as 0; of several inserts
(or revises) of one document in a batch that with the largest count acts, then
that with the largest source and lang; an empty batch commits with no rows; groups
whose documents are all gone have no row; extra columns are ignored.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, shared_path
from .bpe import encoder, vocabulary_json
from .common import small, table

LEDGER = "batch_no long, version string, doc_id long, source string, lang string, n_tokens long, present boolean"
PIECES = 1_000_000  # pieces that a counting worker remembers
DELTA = "version string, source string, lang string, docs long, tokens long"
KEY = ("version", "doc_id")


class Rollup:
    """A roll-up store in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> list[tuple[int, str, str]]:
        """(place, batch, attempt) of the committed batches, in order."""
        if not self._fs.exists(self._path(f"{self.path}/commits")):
            return []
        rows = self.spark.read.parquet(f"{self.path}/commits/*").collect()
        return sorted((r.batch_no, r.batch, r.attempt) for r in rows)

    def _read(self, part: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/batches/{b}/{a}/{part}" for _, b, a in self.commits()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        """What each present document counts: its last committed row."""
        last = F.max_by(F.struct("source", "lang", "n_tokens", "present"), "batch_no").alias("x")
        return (self._read("ledger", LEDGER).groupBy(*KEY).agg(last).select(*KEY, "x.*").where("present").drop("present"))

    def totals(self) -> DataFrame:
        """(version, source, lang, docs, tokens), the sums of all deltas."""
        return (self._read("delta", DELTA).groupBy("version", "source", "lang")
                .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0"))

    def commit(self, batch: str, rows: DataFrame, version: str) -> bool:
        """Apply a batch; False if it was committed before (nothing is done)."""
        done = self.commits()
        if any(b == batch for _, b, _ in done):
            return False
        no, attempt = (done[-1][0] + 1 if done else 0), uuid.uuid4().hex
        row = F.struct("source", "lang", F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"))
        largest = lambda op: F.max_by("row", F.when(F.col("op") == op, F.struct("row.n_tokens", "row"))).alias(op)
        new = (rows.where("op in ('delete', 'insert', 'revise')")
               .select(F.lit(version).alias("version"), F.col("doc_id").cast("long").alias("doc_id"), "op", row.alias("row"))
               .groupBy(*KEY).agg(F.bool_or(F.col("op") == "delete").alias("gone"), largest("insert"), largest("revise")))
        old = self.ledger().select(*KEY, F.struct("source", "lang", "n_tokens").alias("old"))
        n, o = new.alias("n"), old.alias("o")
        act = (n.join(o, (F.col("n.version") == F.col("o.version")) & F.col("n.doc_id").eqNullSafe(F.col("o.doc_id")), "left")
               .select("n.version", "n.doc_id", "old", F.coalesce(F.when(~F.col("gone"), F.col("old")), "insert").alias("new"), "revise")
               .select("version", "doc_id", "old", F.when(F.col("new").isNotNull(), F.coalesce("revise", "new")).alias("new"))
               .where(~F.col("new").eqNullSafe(F.col("old"))))
        at = f"{self.path}/batches/{batch}/{attempt}"
        (act.select(F.lit(no).cast("long").alias("batch_no"), *KEY, F.coalesce("new", "old").alias("x"),
                    F.col("new").isNotNull().alias("present"), "old")
         .select("batch_no", *KEY, "x.source", "x.lang", "x.n_tokens", "present", "old").write.parquet(f"{at}/ledger"))
        written = self.spark.read.parquet(f"{at}/ledger")
        signed = F.explode(F.array(
            F.struct(F.lit(-1).alias("sign"), "old.source", "old.lang", "old.n_tokens", F.col("old").isNotNull().alias("use")),
            F.struct(F.lit(1).alias("sign"), "source", "lang", "n_tokens", F.col("present").alias("use"))))
        (written.select("version", signed.alias("s")).where("s.use").groupBy("version", F.col("s.source").alias("source"), F.col("s.lang").alias("lang"))
         .agg(F.sum("s.sign").cast("long").alias("docs"), F.sum(F.col("s.sign") * F.col("s.n_tokens")).cast("long").alias("tokens"))
         .write.parquet(f"{at}/delta"))
        mark = f"{self.path}/pending-{attempt}"
        self.spark.createDataFrame([(no, batch, attempt)], "batch_no long, batch string, attempt string").coalesce(1).write.parquet(mark)
        self._fs.mkdirs(self._path(f"{self.path}/commits"))
        target = self._path(f"{self.path}/commits/{batch}")
        return not self._fs.exists(target) and bool(self._fs.rename(self._path(mark), target))


def counted(docs: DataFrame, tokenizer_json: str, text: str = "text") -> DataFrame:
    """(doc_id, source, lang, n_tokens, n_flat) by a byte-level tokenizer; a
    null text has 0. ``n_flat`` counts the text with spaces for line breaks:
    both forms in one pass, so that a later revision needs no texts."""
    code = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches):
        enc = encoder(code.value, PIECES)
        for b in small(batches):
            texts = b.column(3).to_pylist()
            n = [len(enc.encode(t)) // 4 if t else 0 for t in texts]
            flat = [len(enc.encode(t.replace("\n", " "))) // 4 if t and "\n" in t else k for t, k in zip(texts, n, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64()), pa.array(flat, pa.int64())],
                                             ["doc_id", "source", "lang", "n_tokens", "n_flat"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, source string, lang string, n_tokens long, n_flat long")


def op7_token_rollup(spark, sf_dir: str) -> DataFrame:
    """Roll-up of all documents after three batches: every document inserted;
    those that ``labels`` marks as low quality deleted; those it marks as
    toxic revised to the count of their text without line breaks. The second
    batch is committed twice, which must not count."""
    import public_tokenizers
    code = vocabulary_json(public_tokenizers.path("byte_bpe_50k.json"))
    version = "byte_bpe_50k"
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    store = Rollup(spark, shared_path(spark, "rollup"))
    counts = materialize(counted(docs, code), "token-counts")
    store.commit("load", counts.withColumn("op", F.lit("insert")), version)
    none = F.lit(None).cast("string")
    poor = labels.where("quality = 0").select(F.lit("delete").alias("op"), "doc_id", none.alias("source"), none.alias("lang"),
                                              F.lit(0).alias("n_tokens"))
    store.commit("poor", poor, version)
    marked = labels.where("toxic = 1").select("doc_id").distinct()
    flat = counts.join(marked, "doc_id", "left_semi").withColumn("n_tokens", F.col("n_flat"))
    store.commit("flat", flat.withColumn("op", F.lit("revise")), version)
    store.commit("poor", poor, version)
    return store.totals()
