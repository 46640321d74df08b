"""Entity documents, exact vector top-k and name resolution.

Exact k-nearest search is brute force by nature. It is organised so that
no task holds more than a bounded block: the query side is split into
chunks of at most ``max_queries`` vectors, each chunk is shipped to the
executors as a broadcast variable (size checked by construction), and every
corpus partition keeps only its local top-k per query (``mapInArrow`` with
NumPy blocks, one result per partition). A final ``row_number() <= k`` per query merges the partial
winners, so the shuffle carries k rows per query per corpus partition, not
all pairs.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions import exprs as X
from ..session import materialize
from .lookups import sized

_BLOCK = 256
_DIFF_CELLS = 4 << 20   # doubles in a block of differences


def entity_documents(airports: DataFrame, airlines: DataFrame) -> DataFrame:
    """One document per airport and airline: text + metadata struct."""
    ap = airports.select(
        F.concat(F.lit("airport:"), F.col("IATA_CODE")).alias("doc_id"),
        X.airport_text().alias("text"),
        F.struct(F.lit("airport").alias("type"), F.col("IATA_CODE").alias("code"),
                 F.col("AIRPORT").alias("name"), F.col("CITY").alias("city"),
                 F.col("COUNTRY").alias("country")).alias("metadata"))
    al = airlines.select(
        F.concat(F.lit("airline:"), F.col("IATA_CODE")).alias("doc_id"),
        X.airline_text().alias("text"),
        F.struct(F.lit("airline").alias("type"), F.col("IATA_CODE").alias("code"),
                 F.col("AIRLINE").alias("name"), F.lit(None).cast("string").alias("city"),
                 F.lit(None).cast("string").alias("country")).alias("metadata"))
    return ap.unionByName(al)


def _distances(q, x, metric):
    """Distances of the rows of ``q`` to the rows of ``x`` (double precision)."""
    if metric == "cosine":
        norms = np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1))
        return 1.0 - (q @ x.T) / np.maximum(norms, 1e-300)
    out = np.empty((len(q), len(x)))
    step = max(1, _DIFF_CELLS // max(1, len(q) * q.shape[1]))
    for t in range(0, len(x), step):  # differences, not the expanded square: equal distances stay equal
        d = q[:, None, :] - x[None, t:t + step, :]
        out[:, t:t + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def _smallest(dist, ids, k):
    """Per row the k smallest (distance, id), unordered: (distances, ids)."""
    if dist.shape[1] <= k:
        return dist, ids
    kth = np.partition(dist, k - 1, axis=1)[:, k - 1:k]
    mask = dist <= kth
    for r in np.flatnonzero(mask.sum(axis=1) > k):  # ties at the k-th distance: lowest ids
        cand = np.flatnonzero(mask[r])
        mask[r, cand[np.lexsort((ids[r, cand], dist[r, cand]))[k:]]] = False
    at = np.nonzero(mask)[1].reshape(len(dist), k)
    return np.take_along_axis(dist, at, 1), np.take_along_axis(ids, at, 1)


def _matrix(column):
    """A vector column as a matrix (copied to doubles)."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _local_topk(shared, k, metric, cid, cvec):
    """Per-partition task (``mapInArrow``): the k nearest rows of one corpus
    partition for every query of a broadcast block. The running best is
    merged over the Arrow batches and returned once per partition."""
    import pyarrow as pa

    def fn(batches):
        qids, qmat = shared.value
        best_d, best_i = np.empty((len(qids), 0)), np.empty((len(qids), 0), np.int64)
        for rb in batches:
            if not rb.num_rows:
                continue
            ids, x = rb.column(cid).to_numpy(zero_copy_only=False), _matrix(rb.column(cvec))
            new_d, new_i = [], []
            for s in range(0, len(qids), _BLOCK):
                d = np.concatenate([best_d[s:s + _BLOCK], _distances(qmat[s:s + _BLOCK], x, metric)], axis=1)
                i = np.concatenate([best_i[s:s + _BLOCK], np.broadcast_to(ids, (len(d), len(ids)))], axis=1)
                d, i = _smallest(d, i, k)
                new_d.append(d)
                new_i.append(i)
            best_d, best_i = np.concatenate(new_d), np.concatenate(new_i)
        if best_d.size:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(qids, best_d.shape[1]), pa.int64()), pa.array(best_i.ravel().astype(np.int64)),
                 pa.array(best_d.ravel(), pa.float64())], names=["query_id", "match_id", "distance"])
    return fn


def _entity_topk(shared, k, metric, qid, qvec):
    """Per-batch task (``mapInArrow``): the k nearest of a small broadcast
    table for every row of a large one; nothing is shuffled or collected."""
    import pyarrow as pa

    def fn(batches):
        ids, mat = shared.value
        for rb in batches:
            for at in range(0, rb.num_rows, _BLOCK):
                part = rb.slice(at, _BLOCK)
                d = _distances(_matrix(part.column(qvec)), mat, metric)
                d, i = _smallest(d, np.broadcast_to(ids, d.shape), k)
                order = np.lexsort((i, d), axis=1)
                d, i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.column(qid).to_numpy(zero_copy_only=False), d.shape[1]), pa.int64()),
                     pa.array(i.ravel().astype(np.int64)), pa.array(d.ravel(), pa.float64())],
                    names=["query_id", "match_id", "distance"])
    return fn


def knn(queries: DataFrame, corpus: DataFrame, k=C.SEARCH_K, metric="l2", qid="query_id", qvec="query_vec",
        cid="vec_id", cvec="embedding", max_queries=4096) -> DataFrame:
    """J7 + T6 / R2: exact top-k neighbours of every query in the corpus.

    The queries are a stated set (one block of at most ``max_queries`` is on
    the driver at a time); for a large query side against few rows see
    ``nearest_entities``. Output (query_id, match_id, distance, rank); ties
    broken by match id.
    ``metric``: 'l2' (Euclidean) or 'cosine' (1 - cosine similarity)."""
    if metric not in ("l2", "cosine"):
        raise ValueError("metric must be 'l2' or 'cosine'")
    spark = queries.sparkSession
    nq = queries.count()
    chunks = max(1, math.ceil(nq / max_queries))
    q = queries.select(F.col(qid).alias("_qid"), F.col(qvec).alias("_qvec"))
    if chunks > 1:
        q = q.withColumn("_chunk", F.pmod(F.xxhash64("_qid"), F.lit(chunks)))
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("match_id", T.LongType()),
                           T.StructField("distance", T.DoubleType())])
    corpus_ids = corpus.select(F.col(cid).cast("long").alias(cid), F.col(cvec))
    parts = []
    for i in range(chunks):
        qi = q.filter(F.col("_chunk") == i) if chunks > 1 else q
        rows = qi.select("_qid", "_qvec").collect()          # <= ~max_queries rows by construction
        if not rows:
            continue
        qids = np.array([int(r[0]) for r in rows], dtype=np.int64)
        qmat = np.array([np.asarray(r[1], dtype=np.float64) for r in rows])
        block = spark.sparkContext.broadcast((qids, qmat))
        parts.append(corpus_ids.mapInArrow(_local_topk(block, k, metric, cid, cvec), schema))
    if not parts:
        return spark.createDataFrame([], schema.add("rank", T.IntegerType()))
    cand = parts[0]
    for p in parts[1:]:
        cand = cand.unionByName(p)
    w = Window.partitionBy("query_id").orderBy("distance", "match_id")
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest_entities(rows: DataFrame, entities: DataFrame, k=C.SEARCH_K, metric="cosine", qid="query_id",
                     qvec="query_vec", eid="entity_id", evec="embedding", max_bytes=C.ENTITY_MAX_BYTES) -> DataFrame:
    """Top-k entities of every row of a large side. The entities are broadcast
    if their vectors take at most ``max_bytes``; beyond that the rows go block
    by block through ``knn``. Output (query_id, match_id, distance)."""
    n = entities.count()
    first = entities.select(F.size(evec)).first()
    if not first or n * first[0] * 8 > max_bytes:
        return knn(rows, entities, k=k, metric=metric, qid=qid, qvec=qvec, cid=eid, cvec=evec).drop("rank")
    small = entities.select(F.col(eid).cast("long"), evec).collect()
    shared = rows.sparkSession.sparkContext.broadcast(
        (np.array([r[0] for r in small], dtype=np.int64), np.array([r[1] for r in small], dtype=np.float64)))
    return rows.select(F.col(qid).cast("long").alias(qid), qvec).mapInArrow(
        _entity_topk(shared, k, metric, qid, qvec), "query_id long, match_id long, distance double")


def _grams(c):
    """Character trigrams of a padded, lower-cased text, as they occur."""
    padded = F.concat(F.lit("  "), F.lower(c), F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))


def name_index(entities: DataFrame, eid="entity_id", text="entity_name") -> tuple[DataFrame, int]:
    """Inverted trigram index of entity names, written once to the shared
    folder, and the number of entities. Rows are (gram, entity_id, w): w is
    what one occurrence of the gram in a query adds to the TF-IDF dot product
    with that entity at length 1. The row with a null entity holds the gram's
    squared IDF, ln((n + 1) / (entities with it + 1))^2. A null name counts as
    empty; ids are taken to be unique."""
    n = entities.count()
    tf = (entities.select(F.col(eid).cast("long").alias("entity_id"), F.explode(_grams(F.coalesce(text, F.lit("")))).alias("gram"))
          .groupBy("entity_id", "gram").agg(F.count("*").alias("tf")))
    tf = materialize(tf, "name-grams")
    idf = tf.groupBy("gram").agg(F.log((n + 1) / (F.count("*") + 1)).alias("idf"))
    part = tf.join(sized(idf, None), "gram")
    norms = part.groupBy("entity_id").agg(F.sqrt(F.sum((F.col("tf") * F.col("idf")) ** 2)).alias("norm"))
    lists = (part.join(sized(norms, n), "entity_id").where("norm > 0")
             .select("gram", "entity_id", (F.col("tf") * F.col("idf") ** 2 / F.col("norm")).alias("w")))
    own = idf.select("gram", F.lit(None).cast("long").alias("entity_id"), (F.col("idf") ** 2).alias("w"))
    return materialize(lists.unionByName(own), "name-index"), n


def nearest_names(names: DataFrame, entities: DataFrame, k=C.SEARCH_K, name="name", eid="entity_id",
                  text="entity_name") -> DataFrame:
    """The k entities with the most similar names for each distinct text of
    ``names``: (name, entity_id, distance), distance being 1 - cosine of the
    trigram TF-IDF vectors, to nine digits; ties go to the smaller id.

    A text meets only the lists of its own trigrams. An entity that shares
    none is at distance 1, so of these only the k smallest ids can matter;
    they are added to every text with nothing shared. Each text is resolved once, however
    many rows have it, and the lists are broadcast only under the size check
    (else joined by gram): then one shuffle by text serves all steps."""
    lists, n = name_index(entities, eid, text)
    texts = names.select(F.col(name).alias("name")).where("name is not null").distinct()
    grams = texts.select("name", F.explode(_grams(F.col("name"))).alias("gram")).groupBy("name", "gram").agg(F.count("*").alias("tf"))
    w = F.coalesce("w", F.lit(math.log(n + 1) ** 2))  # a gram of no entity
    hits = grams.join(sized(lists), "gram", "left").select(
        "name", "entity_id", F.when(F.col("entity_id").isNull(), F.col("tf") * F.col("tf") * w).otherwise(F.col("tf") * w).alias("s"))
    lowest = [r[0] for r in entities.select(F.col(eid).cast("long").alias("e")).orderBy("e").limit(k).collect()]
    rest = texts.select("name", F.explode(F.array(*map(F.lit, lowest)).cast("array<long>")).alias("entity_id"),
                        F.lit(0.0).alias("s"))
    every = Window.partitionBy("name")
    scores = (hits.unionByName(rest).groupBy("name", "entity_id").agg(F.sum("s").alias("s"))
              .withColumn("norm2", F.max(F.when(F.col("entity_id").isNull(), F.col("s"))).over(every)).where("entity_id is not null"))
    distance = F.when(F.col("norm2") > 0, F.round(F.greatest(F.lit(0.0), 1 - F.col("s") / F.sqrt("norm2")), 9)).otherwise(1.0)
    return (scores.select("name", "entity_id", distance.alias("distance"))
            .withColumn("_r", F.row_number().over(every.orderBy("distance", "entity_id"))).where(F.col("_r") <= k).drop("_r"))


def resolve_names(names: DataFrame, entities: DataFrame, name_col="name", id_col="name_id",
                  ent_code="code", ent_name="entity_name", ent_id="entity_id", k=C.SEARCH_K) -> DataFrame:
    """Text -> entity. An exact (upper-cased) code match wins; otherwise
    the best cosine match of character-trigram TF-IDF vectors, with
    Levenshtein distance to the entity name as the tie-break. Also returns
    the top-k candidate codes. A null name gets a null code, match and
    candidates; of codes that differ in case only, the smallest is taken."""
    ents = entities.select(F.col(ent_id).cast("long").alias("entity_id"), F.col(ent_code).alias("code"),
                           F.col(ent_name).alias("entity_name"))
    every = names.select(F.col(id_col).alias("_id"), F.col(name_col).alias("name"))
    near = nearest_names(every, ents, k=k).join(sized(ents), "entity_id")
    near = near.withColumn("lev", F.levenshtein(F.lower("name"), F.lower("entity_name")))
    ranked = near.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy("distance", "lev", "code")))
    top = ranked.groupBy("name").agg(
        F.min_by("code", "_r").alias("best_code"), F.min("distance").alias("best_distance"),
        F.transform(F.sort_array(F.collect_list(F.struct("_r", "code"))), lambda s: s["code"]).alias("candidates"))  # k at most
    exact = ents.groupBy(F.upper("code").alias("_ucode")).agg(F.min("code").alias("exact_code"))
    top = every.join(top, "name", "left").join(sized(exact), F.upper(F.col("name")) == F.col("_ucode"), "left")
    return top.select(F.col("_id").alias(id_col), "name", F.coalesce("exact_code", "best_code").alias("code"),
                      F.when(F.col("exact_code").isNotNull(), F.lit("exact"))
                      .when(F.col("name").isNotNull(), F.lit("similarity")).alias("match"),
                      "best_distance", "candidates")
