"""Byte-level BPE through a sentencepiece model that is serialised directly from a rank vocabulary.

Every token's bytes are written as one character each (the public byte-to-character table), its score is the
negative rank, and normalisation is the identity; sentencepiece's BPE then merges the best-scored (lowest-ranked)
neighbouring pair first, leftmost among equals, as rank-based encoders do. Pre-tokens are encoded one by one, so no
merge crosses them; a pre-token that is itself in the vocabulary is that token. Decoding inverts the table.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .storage import small_batches
from .textops import blocks

#: Distinct pre-tokens that a worker remembers; the memory is emptied when full.
REMEMBERED = 150_000
#: Pre-tokens that are held as Python strings at once.
SLICE = 200_000


def byte_characters() -> list[str]:
    """Printable bytes stand for themselves, the others for the characters from U+0100 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = itertools.count(0x100)
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, payload: bytes | int) -> bytes:
    if isinstance(payload, int):
        return _varint(number << 3) + _varint(payload)
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece ids are the ranks; the unknown piece follows the last rank."""
    chars = byte_characters()
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0..n-1")
    single = np.float32
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        out += _field(1, _field(1, piece) + b"\x15" + single(-rank).tobytes())
    out += _field(1, _field(1, b"<unk>") + b"\x15" + single(0).tobytes() + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens))
    for absent in (41, 42, 43):  # begin, end and padding pieces: id -1
        trainer += _varint(absent << 3) + _varint(2**64 - 1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normaliser))


class Codec:
    """Encodes to little-endian 32-bit ids and back; built once for each worker."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.split = regex.compile(pattern)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.n = self.sp.get_piece_size() - 1
        chars = byte_characters()
        self.table = {b: c for b, c in enumerate(chars)}
        back = {c: b for b, c in enumerate(chars)}
        self.pieces = [bytes(map(back.__getitem__, self.sp.id_to_piece(i))) for i in range(self.n)]
        self.own = {p: np.uint32(i).tobytes() for i, p in enumerate(self.pieces)}
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if len(text) < 4 * SLICE:
            return b"".join(self._slice(self.split.findall(text)))
        found, parts = (m.group() for m in self.split.finditer(text)), []
        while some := list(itertools.islice(found, SLICE)):
            parts += self._slice(some)
        return b"".join(parts)

    def _slice(self, tokens: list[str]) -> list[bytes]:
        known = self.known
        new = [t for t in dict.fromkeys(tokens) if t not in known]
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(dict.fromkeys(tokens))
            todo = []
            for t in new:
                b = t.encode("utf-8")
                if (own := self.own.get(b)) is not None:
                    known[t] = own
                else:
                    todo.append((t, b.decode("latin-1").translate(self.table)))
            for (t, _), ids in zip(todo, self.sp.encode([m for _, m in todo], num_threads=1) if todo else [], strict=True):
                known[t] = np.array(ids, "<u4").tobytes()
        return list(map(known.__getitem__, tokens))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[str, Codec] = {}


def worker_codec(key: str, model: bytes, pattern: str) -> Codec:
    """The codec of this Python worker, which outlives its tasks."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model, pattern)
    return _codecs[key]


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ``token_ids`` (binary: little-endian unsigned 32-bit ids) and ``decoded`` (binary) to every row.

    Null and empty texts have no ids and decode to nothing. Input columns of these two names are replaced. No row is
    dropped and no text cut; rows are independent, so repeats and ties need no rule and no shuffle is made.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # the vocabulary's size is fixed (some 50,000 tokens), so that the model is a bounded broadcast
    serialised = serialise(read_ranks(vocabulary))
    key, model = digest(serialised + pattern.encode()), spark.sparkContext.broadcast(serialised)
    docs = docs.drop("token_ids", "decoded")
    fields = [*docs.schema.fields, T.StructField("token_ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(key, model.value, pattern)
        for batch in batches:
            for lo, hi, _, _ in blocks(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                ids = [codec.encode(t or "") for t in part.column(at).to_pylist()]
                back = [codec.decode(i) for i in ids]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary()), pa.array(back, pa.binary())], names=[f.name for f in fields])

    return docs.mapInArrow(run, T.StructType(fields))


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the two digests of :func:`encode_decode`, taken in the JVM."""
    from pyspark.sql import functions as F

    return encode_decode(docs.select("doc_id", "text"), vocabulary, pattern).select(
        "doc_id",
        (F.length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
