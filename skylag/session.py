"""Spark session and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


OWN_FOLDER = "skylag.checkpoint.own"  # the checkpoint folder that a local session made for itself


def get_session(master: str | None = None, app: str = "skylag",
                shuffle_partitions: int | None = None, extra_conf: dict | None = None) -> SparkSession:
    """Session with the settings the engine relies on.

    On a cluster the launcher owns master/memory; we only pin semantics
    (UTC, ANSI, AQE). ``master`` is used for local runs and tests.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # wide one-pass aggregates (28 correlations, per-column null counts)
        # exceed the default 100-field limit and would lose whole-stage codegen
        "spark.sql.codegen.maxFields": "1000",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and materialised tables.

    The cluster names it in ``spark.checkpoint.dir``; we only create a local
    one when nothing is configured (tests and local runs).
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...): fitted tables and "
                               "stream checkpoints must survive the loss of an executor")
        d = tempfile.mkdtemp(prefix="skylag-ckpt-", dir=os.environ.get("SKYLAG_TMP", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
        spark.conf.set(OWN_FOLDER, d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


SCRATCH_KEY = "skylag.scratch.root"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder (or under the
    current ``scratch_scope``)."""
    root = spark.conf.get(SCRATCH_KEY, None)
    if not root:
        root = ensure_checkpoint_dir(spark).rstrip("/") + "/skylag"
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def scratch_scope(spark: SparkSession, name: str = "job"):
    """Route the intermediates written inside the block (``materialize``,
    ``shared_path``) to one folder on the shared storage and delete it on
    exit. Use it around a job whose outputs are written elsewhere; frames
    that read the intermediates must not be used after the block."""
    root = ensure_checkpoint_dir(spark).rstrip("/") + f"/skylag/{name}-scratch-{uuid.uuid4().hex[:12]}"
    prev = spark.conf.get(SCRATCH_KEY, None)
    spark.conf.set(SCRATCH_KEY, root)
    try:
        yield root
    finally:
        if prev:
            spark.conf.set(SCRATCH_KEY, prev)
        else:
            spark.conf.unset(SCRATCH_KEY)
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(root)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(p):
            fs.delete(p, True)


def materialize(df: DataFrame, name: str, spread_reads: bool = False, partition_by=None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts lineage so later stages (and retries after a lost executor) start
    from durable files instead of recomputing the plan. ``spread_reads``
    is for tables read many times (training matrices): see
    ``sources.tables.spread``. ``partition_by`` writes Hive-style
    partitions so later filters on those columns prune whole folders.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)
    out = spark.read.parquet(path)
    if spread_reads:
        from .sources.tables import path_size, spread
        out = spread(out, path_size(spark, path))
    return out
