"""Identity, second-best and homopolymer scores, reliability, and the output tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequences import homopolymer_compress
from . import lanes
from .align import identity, unstarred


def last_of_name(strands: DataFrame) -> DataFrame:
    """One row a name: the last one's sequence, at the first one's place."""
    return strands.groupBy("name").agg(
        F.min("rank_ordinal").alias("rank_ordinal"), F.max_by("seq", "rank_ordinal").alias("seq")
    )


def reliability(score: Column, second: Column, model: tuple[float, float, float]) -> Column:
    b0, b1, b2 = model
    return F.when(F.lit(b0) + F.lit(b1) * score + F.lit(b2) * (score - second) > 0, "+").otherwise("?")


def score_light(blocks: DataFrame, strands: DataFrame) -> DataFrame:
    """Identity to the assigned monomer alone."""
    own = last_of_name(strands).select(F.col("name").alias("monomer"), F.col("seq").alias("monomer_seq"))
    return (
        blocks.join(F.broadcast(own), "monomer")
        .withColumn("identity", identity(F.col("segment"), F.col("monomer_seq")))
        .withColumns({c: F.lit(None).cast(t) for c, t in _EXTRA.items()})
        .drop("monomer_seq")
    )


_EXTRA = {
    "second_best": "string", "second_best_identity": "double", "homo_best": "string", "homo_best_identity": "double",
    "homo_second_best": "string", "homo_second_best_identity": "double",
}


#: Blocks that are scored together, and monomers that each is aligned with before the bounds of the others are looked at.
TOGETHER, FIRST = 2048, 16


class Candidates:
    """The monomers, a checked list, as both strands of every name."""

    def __init__(self, strands: list):
        rows = sorted(strands, key=lambda s: s["rank_ordinal"])
        self.names, self.seqs, self.homo = ([s[c] for s in rows] for c in ("name", "seq", "homo_seq"))
        first, last = {}, {}
        for k, name in enumerate(self.names):
            first.setdefault(name, k)
            last[name] = k
        #: A name that occurs twice has its first one's place, and only its last one's score counts.
        self.standing = sorted(last, key=first.__getitem__)
        self.rows = np.array([last[n] for n in self.standing])
        self.place = {n: k for k, n in enumerate(self.standing)}
        self.targets = lanes.Targets([unstarred(self.seqs[k]) for k in self.rows])
        self.homo_targets = lanes.Targets([unstarred(h) for h in self.homo])

    @staticmethod
    def _identity(d: np.ndarray, m: np.ndarray) -> np.ndarray:
        return np.where(d < 0, 0.0, m / np.maximum(m + d, 1) * 100)

    @staticmethod
    def _distinct(segments: list[str]) -> tuple[list[str], np.ndarray]:
        """The different segments as they are compared, and the place of each."""
        distinct = {s: k for k, s in enumerate(dict.fromkeys(segments))}
        return [unstarred(s) for s in distinct], np.array([distinct[s] for s in segments])

    @classmethod
    def scores(cls, segments: list[str], targets: lanes.Targets) -> np.ndarray:
        """Identities of every segment with every target."""
        texts, place = cls._distinct(segments)
        return cls._identity(*targets.distances_and_matches(texts))[place]

    @classmethod
    def leaders(cls, segments: list[str], targets: lanes.Targets, own: np.ndarray | None = None) -> np.ndarray:
        """Identities of every segment with the targets of its two highest ones, with all that are as high as the second of them
        and with its ``own``; -1 stands for those that are lower, which are not all aligned.

        The matches of two sequences are at most the letters that they have in common, the columns at least the letters of the longer
        one. The targets with the best such bounds are aligned first; then those whose bound reaches the second highest identity.
        """
        texts, place = cls._distinct(segments)
        many = len(targets.parts)
        longer = np.maximum.outer(np.array([len(t) for t in texts], np.float32), np.array([max(1, len(p)) for p in targets.parts], np.float32))
        bound = lanes.common_letters(texts, targets.parts) / longer * np.float32(100.001)  # a little more, for what rounding takes
        known = np.full(bound.shape, -1.0)
        asked = np.zeros(bound.shape, bool)
        if many > FIRST:
            np.put_along_axis(asked, np.argpartition(-bound, FIRST - 1, axis=1)[:, :FIRST], True, axis=1)
        else:
            asked[:] = True
        if own is not None:
            asked[place, own] = True
        while asked.any():
            query, target = np.nonzero(asked)
            known[query, target] = cls._identity(*targets.chosen_pairs(texts, query, target))
            at, best = np.arange(len(texts)), known.argmax(axis=1)
            highest = known[at, best]
            known[at, best] = -1.0
            second = known.max(axis=1) if many > 1 else highest
            known[at, best] = highest
            asked = (bound >= second[:, None]) & (known < 0)
        return known[place]

    def columns(self, monomers: list[str], segments: list[str], homo_segments: list[str] | None) -> list[pa.Array]:
        """The columns of ``_EXTRA`` and ``identity``, or without ``homo_segments`` every name's identity. Of equal scores the first in rank order comes first."""
        at = np.arange(len(monomers))
        if homo_segments is None:
            known = self.scores(segments, self.targets)
            return [pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * len(self.standing), pa.int32()), pa.array(known.ravel(), pa.float64()))]
        own = np.array([self.place[m] for m in monomers])
        known = self.leaders(segments, self.targets, own)
        others = known.copy()
        others[at, own] = -1.0
        second = others.argmax(axis=1)
        some = others[at, second] >= 0
        homo = self.leaders(homo_segments, self.homo_targets)
        best = np.argsort(-homo, axis=1, kind="stable")[:, :2]
        name = lambda of, k, there: pa.array([of[i] if t else None for i, t in zip(k, there)], pa.string())
        every, two = np.ones(len(at), bool), np.full(len(at), best.shape[1] > 1)
        last = best[:, -1]
        return [
            name(self.standing, second, some), pa.array(others[at, second], pa.float64(), mask=~some),
            name(self.names, best[:, 0], every), pa.array(homo[at, best[:, 0]], pa.float64()),
            name(self.names, last, two), pa.array(homo[at, last], pa.float64(), mask=~two),
            pa.array(known[at, own], pa.float64()),
        ]


def _scored(blocks: DataFrame, strands: list, added: list[T.StructField], homo: bool) -> DataFrame:
    """Every task has the monomers, a list whose length and size the caller has checked, so a block is scored where it is and no pair becomes a row."""
    schema = T.StructType([*blocks.schema.fields, *added])
    rows, kept = [r.asDict() for r in strands], blocks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        candidates = Candidates(rows)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                texts = [part.column(c).to_pylist() for c in ("monomer", "segment", *["homo_segment"] * homo)]
                columns = candidates.columns(*texts, *[None] * (not homo))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *columns], names=schema.names)

    return (blocks.withColumn("homo_segment", homopolymer_compress(F.col("segment"))) if homo else blocks).mapInArrow(run, schema)


def score_full(blocks: DataFrame, strands: list) -> DataFrame:
    """Blocks with identity, second best and best two by homopolymer identity."""
    return _scored(blocks, strands, [*[T.StructField(c, T.StringType() if t == "string" else T.DoubleType()) for c, t in _EXTRA.items()], T.StructField("identity", T.DoubleType())], True)


def alt_table(blocks: DataFrame, strands: list, min_identity: float = 0) -> DataFrame:
    """One row per block and monomer name, the chosen one starred, of blocks whose own identity is at least ``min_identity``."""
    names, all_scores = Candidates([r.asDict() for r in strands]).standing, T.StructField("alt", T.ArrayType(T.DoubleType()))
    scored = _scored(blocks.select("read_ordinal", "read_name", "block_idx", "start", "end", "monomer", "segment"), strands, [all_scores], False)
    named = F.array(*map(F.lit, names))
    kept = scored.withColumn("own", F.array_position(named, F.col("monomer")).cast("int")).where(F.element_at("alt", F.col("own")) >= min_identity)
    rows = kept.select("read_ordinal", "read_name", "block_idx", "start", "end", "own", F.posexplode("alt").alias("alt_idx", "identity"))
    place = F.col("alt_idx") + 1
    return rows.select("read_ordinal", "read_name", "block_idx", "alt_idx", F.element_at(named, place).alias("monomer"), "start", "end", "identity", F.when(place == F.col("own"), "*").otherwise("-").alias("star"))


def no_alt(final: DataFrame) -> DataFrame:
    """The empty table of light mode."""
    return final.limit(0).select("read_ordinal", "read_name", "block_idx", F.lit(0).alias("alt_idx"), "monomer", "start", "end", "identity", F.lit("").alias("star"))
