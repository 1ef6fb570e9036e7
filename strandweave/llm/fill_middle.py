"""Operator 13: fill-in-middle transformation, cut by rank and select over packed boundary bits.

A token is a run of ASCII letters or any other single code point. The texts of an Arrow batch stay
joined as they arrive; one bit a byte says whether a token starts there, another whether a code
point does. Both bit vectors are packed and have a directory of the ones before each block. The ones
between a text's ends are its number of tokens, selecting two of them gives the byte cuts, and the
ranks of code points at the cuts their lengths. Everything around the cuts (hashes, forms, joining,
restoring) is column expressions.

Defined results: a null text counts as empty, which has no tokens and stays plain; a null id is
hashed as the empty text. Texts that hold one of the marks stay plain, so a result can always be
restored from its form. Repeated rows give equal rows; other columns pass through, and the new column
gets a name that is not taken; an empty table stays empty. A text of any length is cut in place, its
bits are made piece by piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clash_free

#: Marks before the three parts, fixed values.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are cut, and of 100 cut ones so many have the suffix first.
CUT, SUFFIX_FIRST = 90, 20
#: Words of 64 bits that share an entry of the directory; bytes whose bits are made at a time.
BLOCK, PIECE = 8, 1 << 20
BITS = 64 * BLOCK


class BitVector:
    """Packed bits (the lowest of a byte first) with the number of ones before each block."""

    def __init__(self, packed: np.ndarray):
        room = np.zeros((len(packed) // (BITS // 8) + 1) * (BITS // 8), np.uint8)
        room[: len(packed)] = packed
        self.words = room.view("<u8").reshape(-1, BLOCK)
        self.before = np.concatenate([[0], np.bitwise_count(self.words).sum(axis=1, dtype=np.int64).cumsum()])

    def rank(self, bits: np.ndarray) -> np.ndarray:
        """Ones before each of the bits."""
        block, inside = np.divmod(bits, BITS)
        taken = np.clip(inside[:, None] - 64 * np.arange(BLOCK), 0, 64).astype(np.uint64)
        low = np.where(taken == 64, ~np.uint64(0), (np.uint64(1) << (taken % np.uint64(64))) - np.uint64(1))
        return self.before[block] + np.bitwise_count(self.words[block] & low).sum(axis=1, dtype=np.int64)

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """The bit of the one that has so many ones before it."""
        block = np.searchsorted(self.before, ranks, side="right") - 1
        ones = np.unpackbits(np.ascontiguousarray(self.words[block]).view(np.uint8), axis=1, bitorder="little")
        return block * BITS + (ones.cumsum(axis=1) > (ranks - self.before[block])[:, None]).argmax(axis=1)


def boundaries(data: np.ndarray, firsts: np.ndarray) -> tuple[BitVector, BitVector]:
    """Token starts and code point starts of joined UTF-8 texts; ``firsts``: the first bytes of texts that are not empty."""
    tokens, points = (np.zeros(-(-len(data) // 8), np.uint8) for _ in range(2))
    inside = False
    for at in range(0, len(data), PIECE):
        part = data[at : at + PIECE]
        letter = (part | 32) - np.uint8(97) < 26
        point = (part & 0xC0) != 0x80
        goes_on = np.empty_like(letter)
        goes_on[1:], goes_on[0] = letter[:-1], inside
        goes_on &= letter
        inside = letter[-1]
        for bits, marks in ((tokens, point & ~goes_on), (points, point)):
            packed = np.packbits(marks, bitorder="little")
            bits[at // 8 : at // 8 + len(packed)] = packed
    np.bitwise_or.at(tokens, firsts >> 3, np.left_shift(1, firsts & 7).astype(np.uint8))
    return BitVector(tokens), BitVector(points)


def cuts(texts: pa.Array, h1: np.ndarray, h2: np.ndarray) -> dict[str, np.ndarray]:
    """Of each text its number of tokens ``n``, the bytes before the cuts after ``h1`` and ``h2`` modulo (n + 1) tokens, lower one first, and code points between."""
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    wide = pa.types.is_large_string(texts.type)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]
    first, last = ends[:-1], ends[1:]
    tokens, points = boundaries(whole, first[last > first])
    before = tokens.rank(first)
    n = tokens.rank(last) - before
    places = [last.copy(), last.copy()]
    for place, cut in zip(places, np.sort([h1 % (n + 1), h2 % (n + 1)], axis=0)):
        inside = cut < n
        place[inside] = tokens.select((before + cut)[inside])
    at = [points.rank(x) for x in (first, *places)]
    return {"n": n, "cut1": places[0] - first, "cut2": places[1] - first, "prefix_chars": at[1] - at[0], "middle_chars": at[2] - at[1]}


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("n", "cut1", "cut2", "prefix_chars", "middle_chars")]))
def _cuts(texts: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    found = cuts(texts, h1.to_numpy(), h2.to_numpy())
    return pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in found.values()], names=list(found))


def hashes(key: Column, seed: int, count: int = 4) -> list[Column]:
    """Groups of eight hexadecimal digits of sha256(``seed:key``) as numbers."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(count)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1) -> tuple[DataFrame, str]:
    """``docs`` with a struct (n, form, prefix_chars, middle_chars, output), and that column's name.

    Form ``psm``: prefix, suffix, middle; ``spm``: suffix, prefix, middle, each after its mark;
    ``plain``: the text itself, and null lengths.
    """
    name, work = clash_free(docs, "fim"), clash_free(docs, "fim_cuts")
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    h1, h2, h3, h4 = hashes(F.col(f"`{key}`"), seed)
    marked = [F.contains(whole, F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)]
    plain = (whole == "") | marked[0] | marked[1] | marked[2] | (h3 % 100 >= CUT)
    form = F.when(plain, "plain").when(h4 % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    rows = docs.withColumn(work, F.struct(_cuts(whole, h1, h2).alias("at"), form.alias("form")))
    at, form, raw = F.col(work)["at"], F.col(work)["form"], whole.cast("binary")
    part = lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int"))
    mark = lambda m: F.lit(m).cast("binary")
    prefix, middle, suffix = part(F.lit(0), at["cut1"]), part(at["cut1"], at["cut2"]), part(at["cut2"], F.octet_length(raw))
    heads = {"psm": (mark(PREFIX), prefix, mark(SUFFIX), suffix), "spm": (mark(SUFFIX), suffix, mark(PREFIX), prefix)}
    output = F.when(form == "plain", whole)
    for kind, head in heads.items():
        output = output.when(form == kind, F.concat(*head, mark(MIDDLE), middle).cast("string"))
    lengths = [F.when(form != "plain", at[c]).alias(c) for c in ("prefix_chars", "middle_chars")]
    return rows.withColumn(name, F.struct(at["n"].alias("n"), form.alias("form"), *lengths, output.alias("output"))).drop(work), name


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. No mark stands in a cut text, and none arises across a cut."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    for_mark = lambda second: (F.substr(F.substring_index(head, second, 1), F.lit(len(PREFIX) + 1)), F.substring_index(head, second, -1))
    prefix, suffix = for_mark(SUFFIX)
    late_suffix, late_prefix = for_mark(PREFIX)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(late_prefix, middle, late_suffix))
