"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_text(name: str) -> str:
    """Content of a vocabulary file (read on the driver, shipped by broadcast)."""
    with open(name, encoding="utf-8") as f:
        return f.read()


def small(batches, most: int = 2 << 20):
    """The batches cut into slices of about ``most`` bytes (one row at least),
    so that what a task holds does not follow the session's batch size."""
    for b in batches:
        step = max(1, b.num_rows * most // max(1, b.nbytes))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


_KEPT: dict = {}


def _release() -> None:
    """Return freed memory to the system: workers are used again by later
    stages, and what they only once needed would count for ever."""
    import ctypes
    import gc

    import pyarrow as pa
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def kept(key=None, make=None):
    """What a Python worker keeps between tasks: one object, the last that was
    asked for. Asking for another key (or for none) drops it first and gives
    the memory back, so the caches of one operator don't stand beside those of
    the next."""
    if key not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            _release()
        if key is not None:
            _KEPT[key] = make()
    return _KEPT.get(key)


def frame_schema(df: DataFrame, added: str):
    """Schema of ``df`` with the ``added`` DDL columns behind it."""
    from pyspark.sql.types import StructType
    extra = StructType.fromDDL(added)
    kept = [f for f in df.schema.fields if f.name not in extra.names]
    return StructType(kept + list(extra.fields))


def lowest(rows: DataFrame, n: int) -> list:
    """About ``n`` rows (h, t) with the lowest hashes h, as a bounded sample
    for a fit: only hashes are ranked, then the rows below the last one are
    fetched (repeated hashes may add up to n more)."""
    limit = rows.select("h").orderBy("h").limit(n).agg(F.max("h")).first()[0]
    got = [] if limit is None else rows.where(F.col("h") <= limit).limit(2 * n).collect()
    return sorted(got, key=lambda r: (r.h, r.t))


def is_small(df: DataFrame, max_rows: int = 1_000_000) -> bool:
    """Whether ``df`` holds at most ``max_rows`` rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def sized_broadcast(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """``df`` with a broadcast hint if it holds at most ``max_rows`` rows (a
    few long columns are meant), else as it is (the planner shuffles)."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: (id, component), component being the
    smallest id reachable. Only ids that occur in an edge are returned.

    Alternating large-star / small-star rounds (O(log n) of them on real
    graphs) until every tree is a star; each round is two aggregations by
    minimum and two joins, written to the shared folder. No neighbour list is
    ever collected: a hub with any number of links is combined map-side for
    its minimum. Its links then stream through one task of the join, which
    holds one row of the hub at a time but is not split; callers shorten that
    by contracting what they know to be connected.
    """
    cur = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    cur = materialize(cur, "cc")
    for _ in range(max_rounds):
        if _stars(cur):
            break
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: larger neighbours of u point to the smallest in its neighbourhood
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.where("u <> m").select("u", F.col("m").alias("v"))).distinct())
        # small star: u and its smaller neighbours point to the smallest of them
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        tight = (large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low2.select("u", F.col("m").alias("v"))).distinct())
        cur = materialize(tight, "cc")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return (cur.select(F.col("u").alias("id"), F.col("v").alias("component"))
            .union(cur.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one parent at most and no parent has one."""
    nodes = (edges.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent"))
             .union(edges.select("v", F.lit(0), F.lit(1))).groupBy("x").agg(F.sum("child").alias("c"), F.max("parent").alias("p")))
    return nodes.where("c > 1 or (c = 1 and p = 1)").isEmpty()
