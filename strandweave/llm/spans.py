"""Spans (kind, start, end) as columns: code points, end exclusive."""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clash_free

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FOUND = T.StructType([T.StructField("base", T.ArrayType(SPAN)), T.StructField("spans", T.ArrayType(SPAN))])
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def arrow_spans(rows: list[list[tuple]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in r] for r in rows], ARROW_SPANS)


def found_array(base: list[list[tuple]], spans: list[list[tuple]]) -> pa.Array:
    return pa.StructArray.from_arrays([arrow_spans(base), arrow_spans(spans)], names=["base", "spans"])


def in_order(spans: list[tuple], kinds: tuple) -> list[tuple]:
    """By start, then by the place of the kind in ``kinds``, then by end."""
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def free_of(spans: list[tuple], taken: list[tuple]) -> list[bool]:
    """Whether each of ``spans`` overlaps none of ``taken`` (in any order, overlapping ones allowed)."""
    starts, ends, far = [], [], 0
    for _, a, b in sorted(taken, key=lambda s: s[1]):
        far = max(far, b)
        starts.append(a)
        ends.append(far)  # the furthest end of all that start up to here
    out = []
    for _, a, b in spans:
        at = bisect.bisect_left(starts, b)
        out.append(not at or ends[at - 1] <= a)
    return out


def with_found(df: DataFrame, found) -> DataFrame:
    """``df`` with the parts of a ``FOUND`` column as ``base`` and ``spans``, or the next free names."""
    made, base = clash_free(df, "found"), clash_free(df, "base")
    out = df.withColumn(made, found).withColumn(base, F.col(made)["base"])
    return out.withColumn(clash_free(df, "spans"), F.col(made)["spans"]).drop(made)


def joined(column):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(column, kind: str):
    return F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("long")


def mask(text: str, spans: list[tuple], sign: str) -> str:
    """``text`` with each span (overlapping ones together) replaced by ``sign``."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], sign]
        at = b
    return "".join(out) + text[at:]
