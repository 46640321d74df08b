"""Byte-level BPE encoding and decoding with the tokenizers library.

Texts pass through Arrow batches. A byte-level vocabulary writes every byte
as one printable character (``byte_chars``); decoding reverses that table,
so any id sequence decodes to the exact bytes, also where a character is
split over several tokens.

Speed: the split pattern never joins text across "non-space, space,
non-space", so a text is cut there and the ids of the pieces are remembered
per worker (bounded); only unseen pieces reach the library.

Defined results: a null text encodes like an empty one (no ids); null ids
decode to null; repeated rows and ties give one row each; an empty table
gives an empty table; other columns are kept, and a column that has the name
of an output column is replaced. Very long texts are encoded in slices that
end at such a cut.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frame_schema, kept, load_text, small, table

CUT = re.compile(r"(?<=\S) (?=\S)")
#: Other white space: a space beside one of these need not begin a match.
OTHER_SPACE = [chr(c) for c in range(0x3001) if chr(c).isspace() and c != 0x20]
#: Fixed: the split pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORDS = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
MARKS = tuple(",.;:!?")
SLICE = 1 << 20          # characters encoded at a time
CACHE_PIECES = 250_000   # remembered pieces per worker
CACHE_CHARS = 8_000_000
MAX_VOCAB_BYTES = 64 << 20


def byte_chars() -> list[str]:
    """The printable character of each byte: printable Latin-1 bytes stand for
    themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in own}
    for b in range(256):
        if b not in out:
            out[b] = chr(0x100 + len(out) - len(own))
    return [out[b] for b in range(256)]


def parse_ranks(content: str) -> dict[bytes, int]:
    """token bytes -> rank, from lines of "base64 rank"."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in content.splitlines() if x.strip())}


def _parts(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What ``token`` is merged from: merges of lower rank only, lowest first."""
    parts, top = [token[i:i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], top), i) for i in range(len(parts) - 1))
        if rank >= top:
            break
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts


def tokenizer_from_ranks(ranks: dict[bytes, int]) -> str:
    """Tokenizer JSON that encodes as the rank file says: every match of
    ``PATTERN`` alone, whole matches by their own rank first."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers
    chars = byte_chars()
    spell = lambda t: "".join(chars[x] for x in t)
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1 and len(p := _parts(token, ranks)) == 2:
            merges.append((spell(p[0]), spell(p[1])))
    tok = Tokenizer(models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tok.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(PATTERN), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tok.to_str()


def _spaces_meet(s: str) -> bool:
    """Whether a space stands beside other white space, so that it may not be
    cut at: only "non-space, space, non-space" always begins a match."""
    return "  " in s or any(c in s and (c + " " in s or " " + c in s) for c in OTHER_SPACE)


class _Pieces(dict):
    """piece -> ids, filled on demand; ``lead`` stands before every piece."""

    def __init__(self, owner, lead: str):
        self.owner, self.lead = owner, lead

    def __missing__(self, piece: str) -> bytes:
        self[piece] = ids = self.owner.piece_ids(self.lead + piece)
        self.owner.chars += len(piece)
        return ids


class PieceEncoder:
    """text -> ids (little-endian unsigned 32-bit) by a byte-level tokenizer."""

    def __init__(self, tokenizer_json: str, pieces: int | None = None):
        self.pieces = pieces or CACHE_PIECES
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(tokenizer_json)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.model = self.tok.model
        chars = byte_chars()
        self.spell = "".join(chars)
        back = {c: b for b, c in enumerate(chars)}
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.table: list[bytes | None] = [None] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            if all(c in back for c in s):
                self.table[i] = bytes(back[c] for c in s)
        self.lens = np.array([len(t) if t is not None else 0 for t in self.table], dtype=np.int64)
        self._clear()

    def _clear(self):
        self.rest = _Pieces(self, " ")
        self.heads = _Pieces(self, "")
        self.chars = 0

    def piece_ids(self, piece: str) -> bytes:
        """Ids of a piece: its words through the byte-to-character table and
        the merges. Beyond the Latin blocks the library's own splitter is
        asked, so that its Unicode tables decide."""
        if not piece.isascii() and max(piece) > "ɏ":
            return np.array(self.tok.encode_batch_fast([piece], add_special_tokens=False)[0].ids, "<u4").tobytes()
        body = piece[1:] if piece[:1] == " " else piece
        if not body.isalpha():
            if body[-1:] in MARKS and body[:-1].isalpha():  # most pieces: a word and the mark behind it
                return (self.heads if body is piece else self.rest)[body[:-1]] + self.heads[body[-1]]
            words = WORDS.findall(piece)
            if len(words) != 1:  # each word is remembered as a piece, too
                return b"".join([self.rest[w[1:]] if w[0] == " " else self.heads[w] for w in words])
        spelt = piece.encode().decode("latin-1").translate(self.spell)
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def _slices(self, text: str):
        at = 0
        while len(text) - at > SLICE and (m := CUT.search(text, at + SLICE)):
            yield text[at:m.start()]
            at = m.end()
        yield text[at:] if at else text

    def encode(self, text: str) -> bytes:
        """Ids of a text, as bytes. Added tokens of the vocabulary count where
        their text stands, as by the library's default."""
        if any(a in text for a in self.added):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out = []
        for k, s in enumerate(self._slices(text) if len(text) > SLICE else (text,)):
            if len(self.rest) + len(self.heads) > self.pieces or self.chars > CACHE_CHARS * (self.pieces // CACHE_PIECES or 1):
                self._clear()
            parts = CUT.split(s) if _spaces_meet(s) else s.split(" ")
            if not k:
                out.append(self.heads[parts[0]])
                parts = islice(parts, 1, None)
            out.extend(map(self.rest.__getitem__, parts))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """Exact bytes of an id sequence."""
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def offsets(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        """Code-point start and end of each token, and how many tokens begin or
        end inside a character (such a token covers the whole character)."""
        ends = np.cumsum(self.lens[np.frombuffer(ids, dtype="<u4")])
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        if text.isascii():
            return starts, ends, 0
        lead = (np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80
        upto = np.concatenate([[0], np.cumsum(lead)])            # characters that begin before a byte
        whole = np.concatenate([lead, [True]])
        a = upto[starts] - ~whole[starts]
        return a, upto[ends], int((~whole[starts] | ~whole[ends]).sum())


def encoder(tokenizer_json: str, pieces: int | None = None) -> PieceEncoder:
    """The worker's encoder of a tokenizer (kept between tasks), remembering
    ``pieces`` pieces."""
    key = ("bpe", hashlib.sha256(tokenizer_json.encode()).hexdigest(), pieces)
    return kept(key, lambda: PieceEncoder(tokenizer_json, pieces))


def vocabulary_json(path: str) -> str:
    """Tokenizer JSON of a .json tokenizer file or of a rank file."""
    content = load_text(path)
    if len(content) > MAX_VOCAB_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCAB_BYTES} bytes")
    if path.endswith(".json"):
        return content
    return tokenizer_from_ranks(parse_ranks(content))


def encode(df: DataFrame, tokenizer_json: str, text: str = "text", ids: str = "ids", offsets: bool = False,
           keep_text: bool = True) -> DataFrame:
    """Adds ``ids`` (binary, little-endian unsigned 32-bit), ``n_split``
    (tokens that cut a character) and, with ``offsets``, ``starts`` and
    ``ends`` (binary, little-endian int32 code-point offsets per token).
    ``keep_text=False`` drops the text column."""
    added = f"{ids} binary, n_split int" + (", starts binary, ends binary" if offsets else "")
    schema = frame_schema(df if keep_text else df.drop(text), added)
    names = [f.name for f in schema.fields]
    code = df.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches):
        enc = encoder(code.value)
        for b in small(batches):
            texts = [t or "" for t in b.column(text).to_pylist()]
            got = [enc.encode(t) for t in texts]
            split, starts, ends = [], [], []
            for t, g in zip(texts, got, strict=True):
                a, z, n = enc.offsets(t, g)
                split.append(n)
                if offsets:
                    starts.append(a.astype("<i4").tobytes())
                    ends.append(z.astype("<i4").tobytes())
            new = {ids: pa.array(got, pa.binary()), "n_split": pa.array(split, pa.int32())}
            if offsets:
                new |= {"starts": pa.array(starts, pa.binary()), "ends": pa.array(ends, pa.binary())}
            yield pa.RecordBatch.from_arrays([new[n] if n in new else b.column(n) for n in names], names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer_json: str, ids: str = "ids", out: str = "decoded", keep_ids: bool = True) -> DataFrame:
    """Adds ``out`` (binary): the bytes that ``ids`` stand for. An id that the
    vocabulary lacks fails the job."""
    schema = frame_schema(df if keep_ids else df.drop(ids), f"{out} binary")
    names = [f.name for f in schema.fields]
    code = df.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches):
        enc = encoder(code.value)
        for b in small(batches):
            got = pa.array([None if x is None else enc.decode(x) for x in b.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([got if n == out else b.column(n) for n in names], names)

    return df.mapInArrow(run, schema)


def encode_checked(df: DataFrame, tokenizer_json: str, text: str = "text", pieces: int | None = None) -> DataFrame:
    """The other columns of ``df`` with ``ids`` (as by ``encode``), ``n_tokens``
    and ``round_trip``: whether the ids decode to the bytes of the text. One
    worker a task encodes and decodes, and the text stays there."""
    schema = frame_schema(df.drop(text), "ids binary, n_tokens long, round_trip boolean")
    names = [f.name for f in schema.fields]
    code = df.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches):
        enc = encoder(code.value, pieces)
        for b in small(batches):
            texts = [t or "" for t in b.column(text).to_pylist()]
            got = [enc.encode(t) for t in texts]
            new = {"ids": pa.array(got, pa.binary()), "n_tokens": pa.array([len(g) // 4 for g in got], pa.int64()),
                   "round_trip": pa.array([enc.decode(g) == t.encode() for g, t in zip(got, texts, strict=True)], pa.bool_())}
            yield pa.RecordBatch.from_arrays([new[n] if n in new else b.column(n) for n in names], names)

    return df.mapInArrow(run, schema)


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole text encoded by the rank file and decoded again; digests of
    the ids and of the decoded bytes."""
    import public_tokenizers
    code = vocabulary_json(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, code, keep_text=False).withColumns({
        "n_tokens": (F.octet_length("ids") / 4).cast("long"), "ids_sha256": F.sha2("ids", 256)})
    return decode(coded, code, keep_ids=False).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("n_split").cast("long").alias("n_split"))
