"""Token-id files: one zstandard dictionary, one frame per document.

A store is a folder with
  ``dictionary.zdict``         the shared dictionary (may be empty)
  ``part-<n>-<attempt>.ids``   shard files
  ``manifest``                 Parquet, one row per shard: which attempts count

Shard file: 8 bytes magic, 32 bytes SHA-256 of the dictionary, 1 byte id
width (2 or 4), the frames, then the offset index (per document: has_id u1,
doc_id i8, token start in the shard i8, tokens i8, frame offset i8, frame
length i8; little-endian) and the footer (index offset i8, documents i8,
magic). A reader that wants few documents reads footer, index and their
frames only.

Shards hold ascending ranges of (doc_id, hash of the text), so documents are
stored in ascending doc_id order. A task writes its own attempt's file and
reports it; only reported files enter the manifest, so lost or repeated
tasks leave no wrong rows.

Defined results: a null text is stored like an empty one; null doc_ids come
first; repeated rows are stored once each, ties ordered by the hash of the
text; an empty table gives an empty manifest; other columns are not stored.
Long texts are encoded in slices and stored whole.

The dictionary is trained on the id arrays of a bounded sample: of at most
``DICT_DOCS`` documents, lowest hash of doc_id first, the first
``DICT_CHARS`` characters. Every document is encoded whole.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_path
from .bpe import encoder, vocabulary_json
from .common import lowest, small, table

MAGIC = b"TOKIDS01"
DICT_DOCS, DICT_CHARS, DICT_BYTES = 1500, 4096, 1 << 16
LEVEL = 3
PIECES = 1_000_000  # pieces that a writing worker remembers (about 200 MB); there is no other Python stage beside it
INDEX = np.dtype([("has_id", "u1"), ("doc_id", "<i8"), ("start", "<i8"), ("n", "<i8"), ("at", "<i8"), ("len", "<i8")])
MANIFEST = "part int, file string, n_docs long, n_tokens long, bytes long, dict_sha256 string"


def _fs(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path)


def _width(vocab_size: int) -> int:
    return 2 if vocab_size <= 1 << 16 else 4


def train_dictionary(docs: DataFrame, tokenizer_json: str, width: int) -> bytes:
    """Dictionary from the bounded sample, a slice at a hashed place of each of
    its documents; empty if the sample is too small."""
    import zstandard
    rows = lowest(docs.select(F.xxhash64("doc_id").alias("h"), F.expr(
        f"substring(text, 1 + cast(pmod(xxhash64(doc_id, 'slice'), greatest(length(text) - {DICT_CHARS}, 0) + 1) as int), {DICT_CHARS})").alias("t"))
                  .where("t is not null"), DICT_DOCS)
    enc = encoder(tokenizer_json)
    samples = [_pack(enc.encode(r.t), width) for r in rows]
    try:
        return zstandard.train_dictionary(DICT_BYTES, [s for s in samples if s]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _pack(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _zdict(raw: bytes):
    import zstandard
    return {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}


def write(docs: DataFrame, path: str, tokenizer_json: str, end_id: int | None = 0) -> None:
    """Encode ``docs`` (doc_id, text), append ``end_id`` to each and store them."""
    spark = docs.sparkSession
    width = _width(max(encoder(tokenizer_json).lens.size, (end_id or 0) + 1))
    raw = train_dictionary(docs, tokenizer_json, width)
    sha = hashlib.sha256(raw).digest()
    fs, root = _fs(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary.zdict") as f:
        f.write(raw)
    code, shared = spark.sparkContext.broadcast(tokenizer_json), spark.sparkContext.broadcast(raw)
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches):
        import zstandard
        from pyspark import TaskContext
        enc, part = encoder(code.value, PIECES), TaskContext.get().partitionId()
        pack = zstandard.ZstdCompressor(level=LEVEL, **_zdict(shared.value))
        fs, root = _fs(path)
        name, out, index, at, start = f"part-{part:06d}-{uuid.uuid4().hex}.ids", None, [], 41, 0
        for b in small(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}")
                    out.write(MAGIC + hashlib.sha256(shared.value).digest() + bytes([width]))
                ids = enc.encode(text or "") + end
                frame = pack.compress(_pack(ids, width))
                out.write(frame)
                index.append((doc is not None, doc or 0, start, len(ids) // 4, at, len(frame)))
                at, start = at + len(frame), start + len(ids) // 4
        if out is None:
            return
        out.write(np.array(index, INDEX).tobytes() + np.array([at, len(index)], "<i8").tobytes() + MAGIC)
        out.close()
        yield pa.RecordBatch.from_pylist([{"part": part, "file": name, "n_docs": len(index), "n_tokens": start,
                                           "bytes": at, "dict_sha256": sha.hex()}],
                                         schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()),
                                                           ("n_tokens", pa.int64()), ("bytes", pa.int64()),
                                                           ("dict_sha256", pa.string())]))

    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id", F.xxhash64("text"))
     .sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(run, MANIFEST).write.parquet(f"{path}/manifest"))


def _index(f) -> np.ndarray:
    """The offset index of an open shard."""
    f.seek(f.size() - 24)
    tail = f.read(24)
    if tail[16:] != MAGIC:
        raise ValueError("not a token-id shard")
    at, n = np.frombuffer(tail[:16], "<i8").tolist()
    f.seek(at)
    return np.frombuffer(f.read(n * INDEX.itemsize), INDEX)


class _Shard:
    def __init__(self, fs, root: str, name: str, raw_dict: bytes):
        import zstandard
        self.f = fs.open_input_file(f"{root}/{name}")
        head = self.f.read(41)
        if head[:8] != MAGIC or head[8:40] != hashlib.sha256(raw_dict).digest():
            raise ValueError(f"{name} was written with another dictionary")
        self.width, self.index = head[40], _index(self.f)
        self.unpack = zstandard.ZstdDecompressor(**_zdict(raw_dict))

    def ids(self, frame: bytes) -> bytes:
        got = self.unpack.decompress(frame)
        return got if self.width == 4 else np.frombuffer(got, "<u2").astype("<u4").tobytes()

    def document(self, row) -> bytes:
        self.f.seek(int(row["at"]))
        return self.ids(self.f.read(int(row["len"])))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every stored document; ``start``
    counts the ids of all documents before it. The running total is over the
    manifest, which has one row per shard."""
    shards = spark.read.parquet(f"{path}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    n = max(1, shards.count())
    jobs = (shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
            .select("file", "base").repartition(n))

    def run(batches):
        fs, root = _fs(path)
        with fs.open_input_stream(f"{root}/dictionary.zdict") as f:
            raw = f.read()
        for b in small(batches):
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = _Shard(fs, root, name, raw)
                for at in range(0, len(s.index), 256):
                    rows = s.index[at:at + 256]
                    s.f.seek(int(rows["at"][0]))
                    block, first = s.f.read(int(rows["len"].sum())), rows["at"][0]
                    got = [s.ids(block[a:a + k]) for a, k in zip((rows["at"] - first).tolist(), rows["len"].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows["doc_id"], pa.int64(), mask=rows["has_id"] == 0), pa.array(rows["start"] + base, pa.int64()),
                         pa.array(rows["n"], pa.int64()), pa.array(got, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return jobs.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def fetch(path: str, files: list[str], doc_id: int) -> list[bytes]:
    """Ids of one document from the given shards: reads each footer and index
    and the document's frames, nothing else."""
    fs, root = _fs(path)
    with fs.open_input_stream(f"{root}/dictionary.zdict") as f:
        raw = f.read()
    out = []
    for name in files:
        s = _Shard(fs, root, name, raw)
        rows = s.index[(s.index["doc_id"] == doc_id) & (s.index["has_id"] == 1)]
        out += [s.document(r) for r in rows]
    return out


def op1_token_ids(spark, sf_dir: str) -> DataFrame:
    """All documents stored as token ids and read back from the files."""
    import public_tokenizers
    path = shared_path(spark, "token-ids")
    write(table(spark, sf_dir, "documents"), path, vocabulary_json(public_tokenizers.path("byte_bpe_50k.json")))
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
