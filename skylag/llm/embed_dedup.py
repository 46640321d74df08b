"""Embedding near-duplicates by randomly rotated binary codes.

1. *Codes.* A unit vector is rotated by fixed random rotations; the signs are
   its code. The correction factor <code, rotated vector>, stored beside it,
   makes <code, rotated other> / factor an unbiased estimate of the cosine,
   with a known standard deviation.
2. *Buckets.* ``tables(n)`` groups of ``bits(n)`` code bits each: vectors that
   agree on a group share its bucket. The bits follow log2 of the number of
   vectors, so that a bucket holds about ``FILL`` unrelated ones; the number
   of groups follows from ``MISS``, the probability that a pair at the
   threshold shares none. Buckets of more than ``HOT`` are cut into blocks of
   ``BLOCK``, compared two by two, so no task holds more than ``HOT`` vectors.
3. *Pairs.* In a block pair the codes are turned back once and all estimates
   are one matrix product; where the
   estimate plus its confidence bound (``SIGMAS`` deviations) reaches the
   threshold, the cosine is recomputed in double precision. A pair counts in the first group
   in which it agrees and nowhere else, so links are counted, not listed; for
   the components a block pair returns a spanning forest of its links.

Identical vectors are one representative with their number. A column of
floats is kept in floats, any other in doubles; cosines are in doubles.

Defined results: vectors that are null, empty, zero, or hold null or
non-finite components link with nothing; vectors of different length never
link; rows with the same id and vector count as one vector and get a row
each; a null id gets no links of its own; an empty table gives none; only id
and vector are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import connected_components, sized_broadcast, small, table

THRESHOLD = 0.9
FILL, MISS, SIGMAS = 800, 1e-6, 6.0
BLOCK, HOT = 1024, 4096


def bits(n: int) -> int:
    return max(2, round(math.log2(max(4, n / FILL))))


def tables(n_bits: int, threshold: float = THRESHOLD) -> int:
    agree = (1 - math.acos(threshold) / math.pi) ** n_bits
    return math.ceil(math.log(MISS) / math.log(1 - agree))


@lru_cache(8)
def rotation(dim: int, n_codes: int) -> np.ndarray:
    """Rows of as many random rotations as ``n_codes`` code bits need."""
    rng = np.random.default_rng(dim)
    out = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-n_codes // dim))]
    return np.vstack(out)[:n_codes].astype(np.float32)


def _units(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), f"<f{len(raw[0]) // dim}").reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _code(x: np.ndarray, n_codes: int):
    """Signs (bool) and correction factors <code, rotated vector>; the code is
    the signs at length 1."""
    r = x @ rotation(x.shape[1], n_codes).T
    return r >= 0, np.abs(r).sum(1) / math.sqrt(n_codes)


def _keys(s: np.ndarray, n_bits: int, n_tables: int) -> np.ndarray:
    return (s.reshape(len(s), n_tables, n_bits) * (1 << np.arange(n_bits, dtype=np.int64))).sum(2)


def vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Usable vectors: (id, dim, raw, h), raw being little-endian floats or
    doubles, as in the column, and h their SHA-256."""
    single = df.schema[embedding].dataType.elementType.typeName() == "float"
    kind, cast = ("<f4", "array<float>") if single else ("<f8", "array<double>")

    def run(batches):
        for b in small(batches):
            ids, raw, dims, h = [], [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i is None or not v or any(x is None for x in v):
                    continue
                a = np.array(v, kind)
                if np.isfinite(a).all() and a.any():
                    ids.append(i)
                    dims.append(len(a))
                    raw.append(a.tobytes())
                    h.append(hashlib.sha256(raw[-1]).digest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary()), pa.array(h, pa.binary())],
                ["id", "dim", "raw", "h"])
    return df.select(F.col(vec_id).cast("long"), F.col(embedding).cast(cast)).mapInArrow(
        run, "id long, dim int, raw binary, h binary")


def codes(reps: DataFrame, n_bits: int, n_tables: int) -> DataFrame:
    """Adds ``code`` (packed bits), ``factor`` and ``keys`` (the code as one
    integer a group)."""
    def run(batches):
        for b in small(batches):
            dims = np.asarray(b.column("dim"))
            code, keys, factor = [None] * b.num_rows, [None] * b.num_rows, np.zeros(b.num_rows)
            raw = b.column("raw").to_pylist()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                s, factor[at] = _code(_units([raw[i] for i in at], int(d)), n_bits * n_tables)
                for i, c, k in zip(at, np.packbits(s, axis=1), _keys(s, n_bits, n_tables).tolist(), strict=True):
                    code[i], keys[i] = c.tobytes(), k
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(code, pa.binary()), pa.array(factor), pa.array(keys, pa.list_(pa.int64()))],
                [*b.schema.names, "code", "factor", "keys"])
    return reps.mapInArrow(run, "id long, dim int, raw binary, h binary, n long, code binary, factor double, keys array<long>")


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """(member, root) rows that connect what the links a-b connect."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    at = np.flatnonzero(label != np.arange(n))
    return np.stack([at, label[at]], 1)


def _compare(n_bits: int, n_tables: int, threshold: float):
    """Links of one block pair: rows (id, links) and (id, other)."""
    none = pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})

    def run(group: pa.Table) -> pa.Table:
        if len(group) < 2:
            return none
        group = group.sort_by("id")  # a tree's root is its smallest vector, in all buckets the same one
        t, own = int(group["t"][0].as_py()), group["s1"][0].as_py() == group["s2"][0].as_py()
        ids, n = np.asarray(group["id"]), np.asarray(group["n"])
        block, first = np.asarray(group["block"]), group["s1"][0].as_py()
        width, dim = n_bits * n_tables, int(group["dim"][0].as_py())
        x = _units(group["raw"].to_pylist(), dim)
        packed = np.frombuffer(b"".join(group["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
        s = np.unpackbits(packed, axis=1)[:, :width].astype(bool)
        keys, factor = _keys(s, n_bits, n_tables), np.asarray(group["factor"])
        left = np.flatnonzero(block == first)
        right = left if own else np.flatnonzero(block != first)
        links = np.zeros(len(ids), np.int64)
        pairs_a, pairs_b = [], []
        # the codes turned back: est = x . back / factor; what a pair at the threshold does not share
        # is a direction at random, so the error's deviation follows from the part of back beside the vector
        back = (np.where(s[right], 1, -1) / math.sqrt(width)) @ rotation(dim, width)
        f = factor[right]
        sigma = math.sqrt(1 - threshold ** 2) * np.sqrt(np.maximum(0, (back * back).sum(1) - f * f)) / f / math.sqrt(max(1, dim - 1))
        limit = (threshold - SIGMAS * sigma - 1e-5) * f
        x32, back = x.astype(np.float32), back.astype(np.float32)
        for at in range(0, len(left), 256):
            some = left[at:at + 256]
            i, j = np.nonzero(x32[some] @ back.T >= limit[None, :])  # both sides times the factor
            i, j = some[i], right[j]
            if own:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 1 << 16):
                a, b = i[k:k + (1 << 16)], j[k:k + (1 << 16)]
                ok = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
                a, b = a[ok], b[ok]
                if t:
                    new = ~(keys[a, :t] == keys[b, :t]).any(1)
                    a, b = a[new], b[new]
                np.add.at(links, a, n[b])
                np.add.at(links, b, n[a])
                pairs_a.append(a)
                pairs_b.append(b)
        a = np.concatenate(pairs_a) if pairs_a else np.empty(0, np.int64)
        b = np.concatenate(pairs_b) if pairs_b else np.empty(0, np.int64)
        tree = _forest(a, b, len(ids))
        some = np.flatnonzero(links)
        return pa.table({"id": np.concatenate([ids[some], ids[tree[:, 0]]]),
                         "links": pa.array(np.concatenate([links[some], np.zeros(len(tree), np.int64)])),
                         "other": pa.array(np.concatenate([ids[some], ids[tree[:, 1]]]), pa.int64(),
                                           mask=np.arange(len(some) + len(tree)) < len(some))})
    return run


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
                    threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    own = materialize(vectors(df, vec_id, embedding), "emb")
    n = max(1, own.agg(F.approx_count_distinct("h")).first()[0])  # sets the width of the buckets only
    reps = (own.groupBy("dim", "raw").agg(F.min("id").alias("id"), F.first("h").alias("h"), F.count_distinct("id").alias("n"))
            .select("id", "dim", "raw", "h", "n"))
    n_bits = bits(n)
    n_tables = tables(n_bits, threshold)
    coded = materialize(codes(reps, n_bits, n_tables), "emb-codes")
    keyed = F.posexplode("keys").alias("t", "key")
    hot = materialize(coded.select("dim", keyed).groupBy("dim", "t", "key").agg(F.count("*").alias("size")).where(F.col("size") > HOT)
                      .select("dim", "t", "key", F.ceil(F.col("size") / BLOCK).cast("int").alias("cut")), "emb-hot")
    blocks = (coded.select("id", "dim", "raw", "n", "code", "factor", F.xxhash64("h").alias("part"), keyed)
              .join(sized_broadcast(hot), ["dim", "t", "key"], "left").withColumn("m", F.coalesce("cut", F.lit(1)))
              .withColumn("block", F.pmod("part", "m").cast("int"))
              .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
              .select("dim", "t", "key", F.least("block", "with").alias("s1"), F.greatest("block", "with").alias("s2"),
                      "block", "id", "n", "raw", "code", "factor"))
    found = materialize(blocks.groupBy("dim", "t", "key", "s1", "s2").applyInArrow(
        _compare(n_bits, n_tables, threshold), "id long, links long, other long"), "emb-links")
    # representatives are told apart by id; two of one id (different vectors) add up
    links = found.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    comp = connected_components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    member = own.select("id", "h").join(coded.select("h", F.col("id").alias("rep"), "n"), "h").select("id", "rep", "n")
    per = (member.join(links.withColumnRenamed("id", "rep"), "rep", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
           .groupBy("id").agg(F.max(F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                              F.min(F.coalesce("component", "rep")).alias("component")))
    return (df.select(F.col(vec_id).cast("long").alias("vec_id")).join(per.withColumnRenamed("id", "vec_id"), "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """All embeddings, cosine of at least 0.9."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
