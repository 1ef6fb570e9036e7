"""Operator 6: language-model scores by deleted interpolation.

Bigram, unigram and uniform estimates are mixed with weights for each bucket of the context's
frequency; the weights come from expectation-maximisation on a fold of the training texts, whose
counts are taken out of the estimates for that purpose.

Texts are taken in blocks of about ``TOKENS`` tokens or more. A block keeps its distinct word and bigram
hashes once, sorted, with counts; slices of the hash space go to reducers as packed arrays (not
as a row for each n-gram). A reducer sums its slice over all blocks and answers every block with
the corpus counts of that block's own n-grams, in order. The texts' packed tokens wait in a file a
block in the shared folder. So a block is scored with nothing but
its own n-grams' counts, no model is broadcast, and a frequent word costs one entry a block.

Defined results: a null or empty text is the end token alone. Repeated rows and ids are texts
like any others; a null id counts as the empty id text. Without training texts every estimate but
the uniform one is 0. Words of any length are whole. Extra columns are not read.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_file, open_fs, pack, release, shared_dir, tidied, unpack
from .ngram_join import _STEP, _Powers, mix

#: Tokens of a block, and UTF-8 bytes of text for each slice of the hash space, up to ``STEADY`` bytes of
#: text; beyond, both grow with the square root of the text, so that the pieces (a block's share of a
#: slice) grow in proportion to it. A task needs about 60 bytes for each token of its block.
TOKENS, SLICE_BYTES, STEADY = 800_000, 24 << 20, 30 << 30
#: A bigram's hash has so many bits beyond those that number the corpus's tokens: two bigrams of a
#: corpus share a hash with a chance of about 2 ** -SPARE_BITS. Word hashes keep all 64 bits.
SPARE_BITS = 22
#: crc32 remainders modulo 10: held out of training, and the fold that the weights are learned on.
HELD_OUT, FOLD = 0, 9
#: Context-frequency buckets (powers of two) and steps per octave of the estimates in the EM's table.
BUCKETS, STEPS = 20, 8
END, BEGIN = np.uint64(0x6C62272E07BB0142), np.uint64(0x27D4EB2F165667C5)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

BLOCK = "block string, slice int, doc_ids array<long>, buckets array<int>, lengths array<int>, payload binary"


def tokens_of(text: str) -> np.ndarray:
    """Hashes of the words of ``text`` and of the end token."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    edge = np.flatnonzero(np.diff(~_SPACE[raw], prepend=False, append=False))
    first, last = edge[::2], edge[1::2]
    out = np.empty(len(first) + 1, np.uint64)
    out[-1] = END
    if len(first):
        up, down = _Powers.of(len(raw) + 1)
        sums = np.empty(len(raw) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((raw + np.uint64(1)) * down[:-1], out=sums[1:])
        out[:-1] = mix((sums[last] - sums[first]) * up[first] + (last - first).astype(np.uint64))
    return out


def rising(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


def _block_rows(docs: list[tuple], slices: int, name: str, bits: int = 64) -> list[tuple]:
    """Rows of one block: its texts (a slice below 0) and a request to every slice."""
    words = [d[2] for d in docs]
    sizes = np.array([len(w) for w in words], np.int64)
    word = np.concatenate(words)
    ends = np.cumsum(sizes)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[ends - sizes] = BEGIN
    bigram = mix(before * _STEP + word) >> np.uint64(64 - bits)
    fold = np.repeat(np.array([d[1] for d in docs]), sizes)
    train, em = (fold != HELD_OUT), (fold == FOLD)
    uw, wi = np.unique(word, return_inverse=True)
    ub, at, bi = np.unique(bigram, return_index=True, return_inverse=True)
    current = wi[at].astype(np.uint32)
    previous = np.where(before[at] == BEGIN, len(uw), np.searchsorted(uw, before[at])).astype(np.uint32)
    count = lambda index, n, of: np.bincount(index[of], minlength=n).astype(np.uint32)
    cw, ew, cb, eb = count(wi, len(uw), train), count(wi, len(uw), em), count(bi, len(ub), train), count(bi, len(ub), em)
    types = bi.astype(np.uint32)
    for a, b in zip(ends - sizes, ends):  # the order of a text's tokens doesn't matter to a sum
        types[a:b] = rising(np.sort(types[a:b]))
    bounds = lambda b: np.array([-(-(k << b) // slices) for k in range(slices)], np.uint64)
    wcut, bcut = np.append(np.searchsorted(uw, bounds(64)), len(uw)), np.append(np.searchsorted(ub, bounds(bits)), len(ub))
    rows = [(name, -1 - zlib.crc32(name.encode()) % slices, [d[0] for d in docs], [d[1] for d in docs], sizes.tolist(), pack(types, current, previous, np.diff(wcut).astype(np.uint32), np.diff(bcut).astype(np.uint32)))]
    for k in range(slices):
        w, b = slice(wcut[k], wcut[k + 1]), slice(bcut[k], bcut[k + 1])
        rows.append((name, k, None, None, None, pack(rising(uw[w]), cw[w], ew[w], rising(ub[b]), cb[b], eb[b])))
    return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
    cols = list(zip(*rows)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["block", "slice", "doc_ids", "buckets", "lengths", "payload"])


def _blocks(slices: int, bits: int, path: str, tokens: int):
    """Rows of all blocks. A block's texts go to a file below ``path``, their row holds its name."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, size, number = [], 0, 0
        fs, folder = open_fs(path)

        def rows() -> pa.RecordBatch:
            head, *asked = _block_rows(docs, slices, f"{part}-{number}", bits)
            file = f"{head[0]}-{uuid.uuid4().hex[:12]}.block"
            with new_file(fs, f"{folder}/{file}") as out:
                out.write(head[5])
            return tidied(_batch([(*head[:5], file.encode()), *asked]))

        part = TaskContext.get().partitionId()  # a task that runs again gives its blocks the same names
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                key = doc.as_py()
                docs.append((key, zlib.crc32(b"" if key is None else str(key).encode()) % 10, tokens_of(text.as_py() or "")))
                size += len(docs[-1][2])
                if size >= tokens:
                    yield rows()
                    docs, size, number = [], 0, number + 1
        if docs:
            yield rows()

    return build


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corpus counts of every request of a slice, then the slice's totals (block null); texts pass through."""

    def done(k: int, asked: list[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(p) for _, p in asked]
        counts, totals = [], []
        for col in (0, 3):
            keys = np.concatenate([np.cumsum(p[col], dtype=np.uint64) for p in parts])
            distinct, back = np.unique(keys, return_inverse=True)
            both = []
            for c in (1, 2):
                total = np.bincount(back, np.concatenate([p[col + c] for p in parts]), len(distinct))
                both.append(total.astype(np.uint32)[back])
                totals.append(int(total.sum()))
            totals.append(int((np.bincount(back, np.concatenate([p[col + 1] for p in parts]), len(distinct)) > 0).sum()))
            counts.append((both, np.cumsum([0] + [len(p[col]) for p in parts])))
        for i, (name, _) in enumerate(asked):
            out = [c[at[i] : at[i + 1]] for both, at in counts for c in both]
            yield _batch([(name, k, None, None, None, pack(*out))])
        yield _batch([(None, k, totals, None, None, b"")])

    slice_, asked = None, []
    for batch in batches:
        for row, (name, k) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if k < 0:
                yield batch.slice(row, 1)
                continue
            if k != slice_:
                if asked:
                    yield from done(slice_, asked)
                slice_, asked = k, []
            asked.append((name, batch.column(5)[row].as_py()))
    if asked:
        yield from done(slice_, asked)


class Block:
    """A block's texts with the corpus counts of its own n-grams."""

    def __init__(self, ids, folds, lengths, payload: bytes, answers: list[bytes]):
        self.ids, self.folds, self.lengths = ids, np.array(folds), np.array(lengths, np.int64)
        types, self.current, self.previous, _, _ = unpack(payload)
        ends = np.cumsum(self.lengths)
        self.starts = ends - self.lengths
        run = np.cumsum(types, dtype=np.int64)
        base = run[self.starts] - types[self.starts]
        self.types = run - np.repeat(base, self.lengths)
        parts = [unpack(a) for a in answers]
        self.cw, self.ew, self.cb, self.eb = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(4))

    def estimates(self, totals: dict, deleted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, bigram estimate, unigram estimate) of each distinct bigram."""
        cw, cb = (self.cw - self.ew, self.cb - self.eb) if deleted else (self.cw, self.cb)
        n = totals["n"] - totals["n_em"] * deleted
        texts = totals["texts"] - totals["texts_em"] * deleted
        context = np.append(cw, texts)[self.previous]
        bucket = np.minimum(BUCKETS - 1, np.floor(np.log2(context + 1)).astype(np.int64))
        return bucket, cb / np.maximum(context, 1), cw[self.current] / max(n, 1)


def _grouped(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[Block]:
    """Blocks from rows sorted by (block, slice)."""
    name, head, answers = None, None, []
    fs, folder = open_fs(path)
    for batch in batches:
        names, slices = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i in range(batch.num_rows):
            if slices[i] < 0:
                if head is not None:
                    yield Block(*head, answers)
                name, answers = names[i], []
                head = [batch.column(c)[i].as_py() for c in (2, 3, 4)]
                with fs.open_input_stream(f"{folder}/{batch.column(5)[i].as_py().decode()}") as source:
                    head.append(source.read())
            else:
                if names[i] != name:
                    raise ValueError("an answer without its block")
                answers.append(batch.column(5)[i].as_py())
    if head is not None:
        yield Block(*head, answers)


def _level(f: np.ndarray) -> np.ndarray:
    """Estimate as a whole number of steps below one; -1 for zero."""
    with np.errstate(divide="ignore"):
        return np.where(f > 0, np.round(-STEPS * np.log2(np.maximum(f, 1e-300))), -1).astype(np.int64)


def learn_weights(cells: np.ndarray, uniform: float, rounds: int = 200) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each bucket by expectation-maximisation.

    cells: rows (bucket, level of the bigram estimate, level of the unigram estimate, tokens).
    A bucket without tokens takes the weights of the bucket below it.
    """
    value = lambda level: np.where(level < 0, 0.0, 2.0 ** (-level / STEPS))
    out = np.full((BUCKETS, 3), 1 / 3)
    for b in range(BUCKETS):
        rows = cells[cells[:, 0] == b]
        if not len(rows):
            out[b] = out[b - 1] if b else (0.0, 0.9, 0.1)
            continue
        f = np.stack([value(rows[:, 1]), value(rows[:, 2]), np.full(len(rows), uniform)], axis=1)
        n, weight = rows[:, 3].astype(float), np.full(3, 1 / 3)
        for _ in range(rounds):
            share = f * weight
            share /= share.sum(axis=1, keepdims=True)
            new = (n[:, None] * share).sum(axis=0) / n.sum()
            new = np.maximum(new, (0.0, 0.0, 1e-6))
            new /= new.sum()
            if np.abs(new - weight).max() < 1e-7:
                break
            weight = new
        out[b] = weight
    return out


def score_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    scale = math.sqrt(max(1.0, total / STEADY))
    slices = max(4, math.ceil(total / (SLICE_BYTES * scale)))
    bits = min(64, max(1, total // 4).bit_length() + SPARE_BITS)
    path = shared_dir(df.sparkSession, "lm-texts")
    asked = rows.mapInArrow(_blocks(slices, bits, path, int(TOKENS * scale)), BLOCK).repartitionById(slices, F.when(F.col("slice") < 0, -1 - F.col("slice")).otherwise(F.col("slice")))
    asked = asked.sortWithinPartitions("slice", "block")
    answers = materialize(asked.mapInArrow(_answer, BLOCK), "lm-counts")
    del asked
    release(df.sparkSession)
    sums = answers.where("block is null").select(*[F.sum(F.col("doc_ids")[k]).alias(f"s{k}") for k in range(6)]).first()
    texts = answers.where("slice < 0").select(F.explode("buckets").alias("f")).groupBy("f").count().collect()
    texts = {r["f"]: r["count"] for r in texts}
    totals = {
        "n": sums["s0"] or 0,
        "n_em": sums["s1"] or 0,
        "v": sums["s2"] or 0,
        "texts": sum(v for k, v in texts.items() if k != HELD_OUT),
        "texts_em": texts.get(FOLD, 0),
    }
    uniform = 1 / (totals["v"] + 1)
    together = answers.where("block is not null").repartition("block").sortWithinPartitions("block", "slice")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _grouped(batches, path):
            bucket, f2, f1 = block.estimates(totals, True)
            hit = np.flatnonzero(block.folds == FOLD)
            seen = np.concatenate([block.types[block.starts[k] : block.starts[k] + block.lengths[k]] for k in hit] or [np.empty(0, np.int64)])
            n = np.bincount(seen, minlength=len(bucket))
            used = n > 0
            key = np.stack([bucket[used], _level(f2[used]), _level(f1[used])], axis=1)
            distinct, back = np.unique(key, axis=0, return_inverse=True)
            sums_ = np.bincount(back.reshape(-1), n[used], len(distinct)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*distinct.T, sums_)], names=["b", "f2", "f1", "n"])

    found = together.mapInArrow(cells, "b long, f2 long, f1 long, n long").groupBy("b", "f2", "f1").agg(F.sum("n").alias("n")).toPandas()
    release(df.sparkSession)
    weights = learn_weights(found[["b", "f2", "f1", "n"]].to_numpy(np.int64), uniform)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = totals["n"], totals["v"]
        for block in _grouped(batches, path):
            bucket, f2, f1 = block.estimates(totals, False)
            w = weights[bucket]
            log = np.log10(w[:, 0] * f2 + w[:, 1] * f1 + w[:, 2] * uniform)
            c = block.cw[block.current]
            base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
            add = lambda x: np.add.reduceat(x[block.types], block.starts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block.ids, pa.int64()),
                    pa.array(block.folds == HELD_OUT, pa.bool_()),
                    pa.array(block.lengths, pa.int64()),
                    pa.array(add((c > 0).astype(np.int64)), pa.int64()),
                    pa.array([n] * len(block.ids), pa.int64()),
                    pa.array(add(base), pa.float64()),
                    pa.array(add(log), pa.float64()),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return together.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
