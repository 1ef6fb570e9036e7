"""Operator 3: byte-level BPE through a sentencepiece model made from the vocabulary.

The vocabulary's byte strings are spelled in printable code points, one a byte, and each
becomes a piece scored by its negative rank, so that sentencepiece's best-scored merge is
the lowest-ranked merge of byte-level BPE. Normalisation is the identity. Every pre-token
is encoded apart; decoding is the inverse byte mapping.

Defined results: a null or empty text has no ids and decodes to no bytes. Repeated rows
give repeated rows, other columns pass through untouched, an empty table stays empty. A
pre-token of any length is encoded whole.
"""

from __future__ import annotations

import base64
import struct

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memory, sized_broadcast, tidied

#: Split rule of the public 50k byte-level vocabulary, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Largest vocabulary file that is broadcast.
VOCABULARY_BYTES = 64 << 20
#: Pre-tokens remembered by a worker (results don't depend on it).
REMEMBERED = 120_000


def read_ranks(path: str) -> list[bytes]:
    """Byte strings of a ``.tiktoken`` file in rank order."""
    with open(path, "rb") as f:
        pairs = [(int(b), base64.b64decode(a)) for a, b in map(bytes.split, f)]
    pairs.sort()
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks are not 0..n-1")
    return [b for _, b in pairs]


def byte_alphabet() -> list[str]:
    """One printable, non-space code point for every byte value."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = iter(range(256, 512))
    keep = set(plain)
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, kind: int, body: bytes | int | float) -> bytes:
    """A protobuf field: kind 0 integer, 2 bytes, 5 float."""
    head = _varint(number << 3 | kind)
    if kind == 0:
        return head + _varint(body)
    if kind == 5:
        return head + struct.pack("<f", body)
    return head + _varint(len(body)) + body


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialized sentencepiece BPE model whose piece ids are the ranks; the unknown piece comes last."""
    letters = byte_alphabet()
    pieces = b"".join(
        _field(1, 2, _field(1, 2, "".join(letters[b] for b in token).encode()) + _field(2, 5, float(-rank)))
        for rank, token in enumerate(tokens)
    )
    unknown = _field(1, 2, _field(1, 2, b"<unk>") + _field(2, 5, 0.0) + _field(3, 0, 2))
    trainer = _field(3, 0, 2) + _field(4, 0, len(tokens) + 1) + _field(40, 0, len(tokens))
    for special in (41, 42, 43):  # no begin, end or padding piece: -1
        trainer += _field(special, 0, (1 << 64) - 1)
    normalizer = _field(1, 2, b"identity") + _field(3, 0, 0) + _field(4, 0, 0) + _field(5, 0, 0)
    return pieces + unknown + _field(2, 2, trainer) + _field(3, 2, normalizer)


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, tokens: list[bytes], pattern: str = PATTERN):
        from sentencepiece import SentencePieceProcessor

        self.tokens = tokens
        self.whole = {t: i for i, t in enumerate(tokens)}
        self.processor = SentencePieceProcessor(model_proto=sentencepiece_model(tokens))
        self.split = regex.compile(pattern).findall
        self.spell = dict(enumerate(byte_alphabet()))
        self.memory = Memory(self._word, REMEMBERED)

    def _word(self, word: str) -> bytes:
        raw = word.encode()
        rank = self.whole.get(raw)  # a pre-token that is a vocabulary entry is that entry
        ids = [rank] if rank is not None else self.processor.encode(raw.decode("latin-1").translate(self.spell))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        memory = self.memory
        ids = b"".join([memory[w] for w in self.split(text)])
        memory.trim()
        return ids

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in memoryview(ids).cast("I")])


_CODECS: dict[tuple, Codec] = {}


def _codec(key: str, blob, pattern: str) -> Codec:
    """The worker's codec; it outlives a task, so its memory is used again."""
    if (key, pattern) not in _CODECS:
        _CODECS.clear()
        tokens = [base64.b64decode(x) for x in blob.value.split(b"\n")]
        _CODECS[key, pattern] = Codec(tokens, pattern)
    return _CODECS[key, pattern]


class ByteBpe:
    """Column functions over one vocabulary: ``encode(text) -> binary ids``, ``decode(ids) -> binary text``."""

    def __init__(self, spark, path: str, pattern: str = PATTERN):
        tokens = read_ranks(path)
        blob = sized_broadcast(spark, b"\n".join(base64.b64encode(t) for t in tokens), VOCABULARY_BYTES)

        def coded(texts: pa.Array, codec: Codec) -> list[bytes]:
            return [codec.encode(t.as_py() or "") for t in texts]

        @F.arrow_udf(T.BinaryType())
        def encode(texts: pa.Array) -> pa.Array:
            return tidied(pa.array(coded(texts, _codec(path, blob, pattern)), pa.binary()))

        @F.arrow_udf(T.BinaryType())
        def decode(ids: pa.Array) -> pa.Array:
            codec = _codec(path, blob, pattern)
            return pa.array([codec.decode(x.as_py() or b"") for x in ids], pa.binary())

        @F.arrow_udf(T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]))
        def round_trip(texts: pa.Array) -> pa.Array:
            codec = _codec(path, blob, pattern)
            ids = coded(texts, codec)
            decoded = [codec.decode(x) for x in ids]
            return tidied(pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=["ids", "decoded"]))

        #: ``round_trip`` encodes once and decodes those ids; ``decode(encode(x))`` next to ``encode(x)`` would encode twice.
        self.encode, self.decode, self.round_trip = encode, decode, round_trip


def encode_documents(df: DataFrame, path: str, text: str = "text", ids: str = "ids", pattern: str = PATTERN) -> DataFrame:
    """``df`` with a binary column of little-endian 32-bit ids; an existing column of that name is replaced."""
    return df.withColumn(ids, ByteBpe(df.sparkSession, path, pattern).encode(F.col(f"`{text}`")))


def decode_documents(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids stand for."""
    return df.withColumn(decoded, ByteBpe(df.sparkSession, path).decode(F.col(f"`{ids}`")))
