"""Near-duplicate detection with HyperMinHash registers.

A document's set: its distinct ``shingle``-word shingles (words are runs of
non-white-space ASCII-wise, A-Z lower-cased); with fewer words the whole
sequence is one shingle; without words the set is empty.

1. *Registers.* A shingle's 64-bit hash picks a bucket; the bucket's minimum
   is kept as its count of leading zeros and ``MANTISSA`` bits behind the
   leading one (16 bits a register). Empty buckets are filled by a fixed
   probe sequence over the full ones, so short texts have all registers.
2. *Classes.* Documents with equal sets (128-bit digest and size) share one
   representative, the smallest doc_id.
3. *Banding.* ``BANDS`` bands of ``ROWS`` registers; representatives that agree
   on a band share a bucket. A pair at similarity 0.8 misses every band with
   a probability of about 2e-6, which only falls above it.
4. *Linking.* Pairs in a bucket whose sizes and one-bit signatures allow the
   similarity are estimated from the registers (agreeing ones less the
   expected chance collisions) and then confirmed on the full sets. A group
   of n near copies is not expanded into n*n pairs: a round compares a
   bucket's members with one pivot and joins what is linked. When few pairs
   of members outside the buckets' largest components are left, or another
   round of pivots has not halved them, all of those are compared, and each
   such member with the whole largest component, in blocks of ``BLOCK`` by
   ``BLOCK`` documents that return links only. So every bucket pair of
   different components is looked at, and no link between them is lost.

Defined results: null, empty and blank texts have n_shingles 0 and are linked
with nothing; repeated rows and rows with one doc_id count as one document
and each get a row; an empty table gives an empty one; only the id and text
columns are read, so clashing extra columns do no harm. Long texts are used
whole. A null doc_id is no document and gets no link.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import connected_components, is_small, kept, sized_broadcast, small, table

BANDS, ROWS, MANTISSA = 56, 7, 10
K = BANDS * ROWS
SIMILARITY = 80          # percent
MARGIN = 5.0             # standard deviations an estimate may fall short by
LEFT_PER_DOC = 16        # remaining bucket pairs a document at which all are looked at
PIVOT_ROUNDS = 6
BLOCK = 256              # documents on either side of a block comparison
SIGNATURE = 6            # longs that hold one bit of each of 64 registers
#: Differing bits of a pair at the threshold: their mean and MARGIN + 0.7 deviations more.
FAR_BITS = int(64 * SIGNATURE * 0.1 + 5.7 * (64 * SIGNATURE * 0.1 * 0.9) ** 0.5)
_M = (1 << 64) - 1


class _WordHashes(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(ws: list[bytes], shingle: int, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, ws), np.uint64, len(ws))
    n = min(shingle, len(ws))
    out = np.full(len(ws) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - n + 1 + k])
    return np.unique(out)


@lru_cache(1)
def _probes() -> np.ndarray:
    """Fixed probe sequence of buckets for each empty register."""
    return np.random.default_rng(20240501).integers(0, K, (64, K))


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16: leading zeros << MANTISSA | mantissa) of
    sorted distinct hashes."""
    out = np.zeros(K, np.uint16)
    if not len(hashes):
        return out
    # sorted hashes lie bucket by bucket: h * K / 2**64 is the bucket, what is left of it the value in there
    high = (hashes >> np.uint64(32)) * np.uint64(K)
    bucket = (high >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    with np.errstate(over="ignore"):
        least = (hashes[first] * np.uint64(K)) >> np.uint64(12)  # 52 bits: exact as doubles
    frac, exp = np.frexp(least.astype(np.float64) + 1.0)
    zeros = np.clip(53 - exp, 0, 63).astype(np.uint16)
    mantissa = np.minimum(((frac - 0.5) * (2 << MANTISSA)).astype(np.uint16), (1 << MANTISSA) - 1)
    regs, full = out.copy(), np.zeros(K, bool)
    full[bucket[first]] = True
    regs[bucket[first]] = (zeros << np.uint16(MANTISSA)) | mantissa
    out[full] = regs[full]
    left = np.flatnonzero(~full)
    for probe in _probes():
        if not len(left):
            return out
        pick = probe[left]
        ok = full[pick]
        out[left[ok]] = regs[pick[ok]]
        left = left[~ok]
    some = np.flatnonzero(full)  # a few shingles only: the rest by a second fixed rule
    with np.errstate(over="ignore"):
        order = _mix(left.astype(np.uint64)[:, None] * np.uint64(K) + some.astype(np.uint64)[None, :])
    out[left] = regs[some[order.argmin(axis=1)]]
    return out


def signature(regs: np.ndarray) -> np.ndarray:
    """One hashed bit of each of the first registers, as int64."""
    with np.errstate(over="ignore"):
        h = _mix(regs[:64 * SIGNATURE].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                 + np.arange(64 * SIGNATURE, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return np.packbits((h & np.uint64(1)).astype(np.uint8)).view(np.int64)


def chance_collisions(n1: int, n2: int) -> float:
    """Expected share of registers that agree although the minima differ
    (two sets of about n1 and n2 elements; the published approximation)."""
    n, m = max(n1, n2, 1) / K, max(1, min(n1, n2)) / K
    phi = 4 * (n / m) / ((1 + n / m) ** 2)
    return 0.169919487159739 * phi / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n1: int, n2: int) -> float:
    """Collision-corrected Jaccard estimate."""
    ec = chance_collisions(n1, n2)
    return max(0.0, (float((a == b).mean()) - ec) / (1 - ec))


def sketch(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 2) -> DataFrame:
    """(doc_id, n_shingles, digest, regs, sig, text) of every document."""
    def run(batches):
        kept()
        cache = _WordHashes()
        for b in small(batches):
            n, digest, regs, sig = [], [], [], []
            for t in b.column(1).to_pylist():
                h = shingle_hashes(words(t), shingle, cache)
                n.append(len(h))
                digest.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                r = registers(h)
                regs.append(r.tobytes() if len(h) else None)
                sig.append(signature(r) if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                                              pa.array(regs, pa.binary()), pa.array(sig, pa.list_(pa.int64())), b.column(1)],
                                             ["doc_id", "n_shingles", "digest", "regs", "sig", "text"])
    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
            .mapInArrow(run, "doc_id long, n_shingles long, digest binary, regs binary, sig array<long>, text string"))


def _low(percent: int) -> float:
    """Least estimate of a pair that is compared in full."""
    return percent / 100 - MARGIN * float(np.sqrt(percent / 100 * (1 - percent / 100) / K))


def _sets(text: str, shingle: int) -> set:
    ws = words(text)
    return {tuple(ws)} if len(ws) < shingle else set(zip(*(ws[k:] for k in range(shingle)), strict=False))


def _similar(x: set, y: set, percent: int) -> bool:
    both = len(x & y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(pairs: DataFrame, full: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose estimate and whose full sets agree.
    Only documents that occur in a pair are moved."""
    # written: the size check, the lookup and its broadcast read the ids, not the pairs again
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "hmh-ids")
    some = full.join(sized_broadcast(ids), "doc_id", "left_semi").select("doc_id", "n_shingles", "regs", "text")
    side = lambda k: some.select(F.col("doc_id").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n_shingles", "regs", "text")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    low = _low(percent)

    def run(batches):
        kept()
        last, of = None, None
        for b in small(batches):
            a, c, n1, n2, r1, r2, t1, t2 = (b.column(k) for k in ("a", "b", "n_shingles_a", "n_shingles_b", "regs_a", "regs_b",
                                                                   "text_a", "text_b"))
            keep = []
            for i in range(b.num_rows):
                x, y = (np.frombuffer(r[i].as_py(), np.uint16) for r in (r1, r2))
                if estimate(x, y, n1[i].as_py(), n2[i].as_py()) < low:
                    continue
                if last != (one := t1[i].as_py()):
                    last, of = one, _sets(one, shingle)
                if _similar(of, _sets(t2[i].as_py(), shingle), percent):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([a.take(pa.array(keep, pa.int64())), c.take(pa.array(keep, pa.int64()))], ["a", "b"])

    return both.select("a", "b", "n_shingles_a", "n_shingles_b", "regs_a", "regs_b", "text_a", "text_b").mapInArrow(
        run, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 2,
                    percent: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    full = materialize(sketch(docs, doc_id, text, shingle), "hmh")
    lean = full.select("doc_id", "n_shingles", "digest")
    usable = full.where("n_shingles > 0 and doc_id is not null")
    copies = materialize(usable.groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c"))
                         .where("c > 1").drop("c"), "hmh-copies")
    # a document without copies stands for itself: only sets that occur more than once are looked up
    placed = usable.join(sized_broadcast(copies), ["digest", "n_shingles"], "left")
    member = materialize(placed.select("doc_id", F.coalesce("rep", "doc_id").alias("rep")), "hmh-member")
    wanted = ["doc_id", "n_shingles", "regs", "sig"]
    reps = placed.where("rep is null").select(*wanted).union(
        placed.where("doc_id = rep").dropDuplicates(["digest", "n_shingles"]).select(*wanted))
    key = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(regs, i * {2 * ROWS} + 1, {2 * ROWS})))")
    mark = F.struct("n_shingles", *[F.col("sig")[i].alias(f"s{i}") for i in range(SIGNATURE)]).alias("mark")
    keys = reps.select(F.col("doc_id").alias("id"), F.explode(key).alias("key"))
    pooled = materialize(keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key"), "hmh-keys")
    if is_small(pooled):   # all bands pass a filter in the scan's tasks, and bring their marks along
        buckets = reps.select(F.col("doc_id").alias("id"), mark, F.explode(key).alias("key")).join(F.broadcast(pooled), "key", "left_semi")
    else:                  # only keys move, the marks join what is left of them
        buckets = keys.join(pooled, "key", "left_semi").distinct().join(reps.select(F.col("doc_id").alias("id"), mark), "id")
    buckets = materialize(buckets.select("key", "id", "mark"), "hmh-buckets")
    n_docs = max(1, member.count())
    links, done, comp, before = [], None, None, None
    for rnd in range(PIVOT_ROUNDS + 1):
        own, per = _pivots(buckets, comp, rnd)
        per = materialize(per, "hmh-pivots")
        some, left = per.agg(F.sum("n_minor"), F.sum(F.col("n_minor") * F.col("n_minor"))).first()
        if not some:
            break
        last = rnd > 0 and (left <= LEFT_PER_DOC * n_docs or left > before / 2) or rnd == PIVOT_ROUNDS
        mixed = own.join(per, "key")
        if last:
            mixed = materialize(mixed, "hmh-mixed")
            pairs = _cross(mixed, percent)
        else:
            pairs = mixed.where(F.col("comp") != F.col("pivot.comp")).where(_near("mark", "pivot.mark", percent)).select(
                F.least("id", "pivot.id").alias("a"), F.greatest("id", "pivot.id").alias("b"))
        pairs = pairs.distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "hmh-pairs")
        done = pairs if done is None else done.union(pairs)
        new = _confirm(pairs, full, shingle, percent)
        if last and comp is not None:
            new = new.union(_against_components(mixed, comp, full, shingle, percent))
        links.append(materialize(new, "hmh-links"))
        if last:
            break
        comp = _merged(_all(links), comp)
        before = left
    comp = _components(_all(links), comp) if links else None
    # classes whose documents share a doc_id with another class meet through that id
    own = member.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    shared = member.groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y")
    if comp is None:
        comp = member.limit(0).select(F.col("doc_id").alias("id"), F.col("rep").alias("component"))
    if not shared.isEmpty():
        comp = connected_components(comp.select(F.col("id").alias("a"), F.col("component").alias("b")).union(own))
    least = (member.join(comp, F.col("rep") == F.col("id"), "left").groupBy("doc_id")
             .agg(F.min(F.coalesce("component", "rep")).alias("component")))
    return (lean.join(least, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))


def _near(x: str, y: str, percent: int):
    """Condition that a pair's set sizes allow the similarity and that their
    signatures differ in no more bits than a pair at the threshold may."""
    n, m = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
    far = sum((F.bit_count(F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}"))) for i in range(SIGNATURE)), F.lit(0))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (far <= FAR_BITS)


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.union(x)
    return out


def _merged(links: DataFrame, comp: DataFrame | None) -> DataFrame:
    """(id, component) of linked documents between rounds: the smallest
    document one or two links away, and what earlier rounds merged. Documents
    with one component are connected; connected ones may still differ, which
    costs comparisons but no link (whole components are found at the end)."""
    edges = links.select(F.col("b").alias("id"), F.col("a").alias("component")).union(links.select("a", "a"))
    if comp is not None:
        edges = edges.union(comp)
    near = materialize(edges.groupBy("id").agg(F.min("component").alias("component")), "hmh-near")
    up = near.where("id <> component").select(F.col("id").alias("component"), F.col("component").alias("further"))
    return materialize(near.join(sized_broadcast(up), "component", "left").select("id", F.coalesce("further", "component").alias("component")),
                       "hmh-merged")


def _components(links: DataFrame, comp: DataFrame | None) -> DataFrame:
    """(id, component) of all linked documents, the component being the
    smallest document reachable. What ``comp`` merged is one node, named by
    its smallest document, so few links are left to be followed. An id can
    have several equal rows."""
    if comp is None:
        return connected_components(links)
    known = sized_broadcast(comp)
    over = lambda c: known.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    edges = (links.join(over("a"), "a", "left").join(over("b"), "b", "left")
             .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b"))
    top = materialize(connected_components(edges), "hmh-top")
    return (comp.join(sized_broadcast(top.select(F.col("id").alias("component"), F.col("component").alias("least"))), "component", "left")
            .select("id", F.coalesce("least", "component").alias("component")).union(top))


def _pivots(buckets: DataFrame, comp: DataFrame | None, rnd: int) -> tuple[DataFrame, DataFrame]:
    """The buckets' members with their components, and the buckets that hold
    several components: the pivot of this round, the largest component
    (``major``), its members (``n_major``) and those outside it (``n_minor``).
    The second is to be written before the two are joined, so that the join
    can split a large bucket."""
    rank = (F.col("id") if rnd == 0 else F.xxhash64("id", F.lit(rnd))).alias("rank")
    if comp is None:
        own = buckets.withColumn("comp", F.col("id"))
        per = own.select("key", F.lit(1).cast("long").alias("k"), "comp", F.struct(rank, "id", "comp", "mark").alias("p"))
    else:
        own = (buckets.join(sized_broadcast(comp), "id", "left").withColumn("comp", F.coalesce("component", "id"))
               .drop("component"))
        per = own.groupBy("key", "comp").agg(F.count("*").alias("k"), F.min(F.struct(rank, "id", "comp", "mark")).alias("p"))
    per = (per.groupBy("key").agg(F.count("*").alias("comps"), F.sum("k").alias("n"), F.min("p").alias("pivot"),
                                  F.max(F.struct("k", "comp")).alias("most")).where("comps > 1"))
    return own, per.select("key", "pivot", F.col("most.comp").alias("major"), (F.col("n") - F.col("most.k")).alias("n_minor"),
                           F.col("most.k").alias("n_major"))


def _cross(mixed: DataFrame, percent: int) -> DataFrame:
    """Near pairs of a bucket's members outside its largest component, and of
    these with that component where it is a single document. Two documents of
    several such buckets meet in the least of these alone, and once there."""
    # by mark, as rows with one doc_id can have several texts, each with its own buckets
    several = Window.partitionBy("id", "mark")
    some = mixed.where("comp <> major or n_major = 1").withColumn("keys", F.collect_set("key").over(several))
    minor = some.where("comp <> major").select("key", "id", "comp", "mark", "keys")
    other = some.select("key", *[F.col(c).alias(f"{c}2") for c in ("id", "comp", "mark", "keys")], (F.col("comp") == F.col("major")).alias("single"))
    return (minor.join(other, "key").where("comp <> comp2 and (single or id < id2)").where(_near("mark", "mark2", percent))
            .where("key = array_min(array_intersect(keys, keys2))")
            .select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")))


def _against_components(mixed: DataFrame, comp: DataFrame, full: DataFrame, shingle: int, percent: int) -> DataFrame:
    """A link of each document that is near a member of its bucket's largest
    component, of several documents, to that component, if there is one. The
    component is compared in blocks, whole; only the links are returned."""
    minor = mixed.where("comp <> major and n_major > 1")
    other = mixed.where("comp = major and n_major > 1").select(F.col("key").alias("k"), F.col("mark").alias("mark2"))
    one = (minor.join(other, (F.col("key") == F.col("k")) & _near("mark", "mark2", percent), "left_semi")
           .select(F.col("id").alias("x"), F.col("major").alias("c")).distinct())
    one = materialize(one, "hmh-single")
    sizes = (comp.groupBy(F.col("component").alias("c")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("m"))
             .join(one.groupBy("c").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nx")), "c"))
    steps = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = (one.join(sizes, "c").withColumn("xb", F.pmod(F.xxhash64("x"), "nx").cast("int")).withColumn("cb", steps("m"))
         .select("c", "cb", "xb", F.col("x").alias("doc_id"), F.lit(True).alias("single")))
    y = (comp.select(F.col("component").alias("c"), "id").join(sizes, "c").withColumn("cb", F.pmod(F.xxhash64("id"), "m").cast("int"))
         .withColumn("xb", steps("nx")).select("c", "cb", "xb", F.col("id").alias("doc_id"), F.lit(False).alias("single")))
    rows = materialize(x.union(y), "hmh-blocks")
    ids = sized_broadcast(rows.select("doc_id").distinct())
    both = rows.join(full.join(ids, "doc_id", "left_semi").select("doc_id", "n_shingles", "regs", "text").where("regs is not null"), "doc_id")
    low = _low(percent)

    def run(group: pa.Table) -> pa.Table:
        ids, single = np.asarray(group["doc_id"]), np.asarray(group["single"])
        n, texts = np.asarray(group["n_shingles"]), group["text"]
        regs = np.frombuffer(b"".join(group["regs"].to_pylist()), np.uint16).reshape(len(ids), -1)
        rest, known, a, b = np.flatnonzero(~single), {}, [], []
        for i in np.flatnonzero(single):
            same = (regs[rest] == regs[i]).mean(1) if len(rest) else np.empty(0)
            mine = None
            for k in np.argsort(-same, kind="stable"):
                if same[k] < low:
                    break
                j = rest[k]
                if estimate(regs[i], regs[j], int(n[i]), int(n[j])) < low:
                    continue
                mine = mine if mine is not None else _sets(texts[int(i)].as_py(), shingle)
                if j not in known:
                    known[j] = _sets(texts[int(j)].as_py(), shingle)
                if _similar(mine, known[j], percent):
                    a.append(ids[i])
                    b.append(ids[j])
                    break
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return both.groupBy("c", "cb", "xb").applyInArrow(run, "a long, b long")


def op2_hyperminhash(spark, sf_dir: str) -> DataFrame:
    """All documents; two-word shingles, similarity of at least 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"))
