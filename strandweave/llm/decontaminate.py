"""Operator 1: benchmark decontamination by q-gram lemma filtering.

Texts and items are compared as words of lower-case letters and digits joined by single
blanks. A stretch of ``WINDOW`` characters (or a whole shorter item) with at most ``ERROR`` edits
per character keeps at least ``window - q + 1 - q * edits`` of its q-grams, all near one
diagonal. So shared q-grams are counted in diagonal bands that overlap by half, over sliding
windows; windows that reach the count become regions. A banded alignment around each region finds
its longest stretch; a region outside it is verified window by window, by edit distance. Regions
are taken by what they can give at most, and one that lies within a stretch that already stands is
left out, so a repeated phrase is aligned on a few of its many diagonals only.

Benchmark items go through in blocks of a bounded size, each against all documents; no join
and no shuffle takes place.

Defined results: null and empty texts and items match nothing; an item that is shorter than
twice q is found where it stands exactly, between word ends; repeated items and rows each
give their rows; a null id is kept. Texts and items of any length are read whole, in time
proportional to them and, where both repeat one phrase, to the number of q-grams that they share
place by place. Of stretches of one item that overlap, the one with the most characters
after its edits stays, of equal ones the first in the text; different items may share a stretch.
Extra columns of the documents are not read. Empty tables give empty results.
"""

from __future__ import annotations

import bisect
import heapq
import math
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized_broadcast, tidied

Q, WINDOW, ERROR = 12, 80, 0.05
#: Diagonals that regions joined into one may span.
SPAN = 64
#: Characters of benchmark items that are compared at a time.
BLOCK_CHARS = 4 << 20
#: Bytes of such a block that are broadcast, at most.
BLOCK_BYTES = 64 << 20
#: Shared q-grams that are looked at together; a text with more is taken in overlapping halves.
HITS = 1 << 21
BLOOM_BITS = 22
_MULTIPLIER = 0x9E3779B97F4A7C15

REGIONS = "doc_id long, item_id long, doc_start long, doc_end long, item_start long, item_end long, edits long, item_share double"

_LOWER = np.arange(65536, dtype=np.uint32)
_WORD = np.zeros(65536, bool)
for _c in range(65536):
    if not 0xD800 <= _c < 0xE000:
        _x = chr(_c)
        _WORD[_c] = _x.isalnum()
        if len(_x.lower()) == 1 and ord(_x.lower()) < 65536:
            _LOWER[_c] = ord(_x.lower())


def normalize(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the compared form, and the place of each in ``text``."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = np.minimum(points, 65535)
    word = _WORD[small] | (points > 65535)
    before = np.empty_like(word)
    if len(word):
        before[0], before[1:] = False, word[:-1]
    place = np.flatnonzero(word | before)
    out = np.where(word, np.where(points < 65536, _LOWER[small], points), 32)[place]
    if len(out) and out[-1] == 32:
        out, place = out[:-1], place[:-1]
    return out, place


def qgrams(points: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of every q-gram, joined from hashes of powers of two."""
    if len(points) < q:
        return np.empty(0, np.uint64)
    factor, size, h, out, done = _MULTIPLIER, 1, points.astype(np.uint64) + np.uint64(1), None, 0
    n = len(points) - q + 1
    while True:
        power = np.uint64(factor)
        if q & size:
            part = h[done : done + n]
            out = part if out is None else out * power + part
            done += size
        if done == q:
            break
        h = h[:-size] * power + h[size:]
        factor, size = factor * factor % (1 << 64), size * 2
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


class Items:
    """One block of benchmark items with its q-gram index."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        self.ids, self.points, self.short = [], [], []
        for item, text in rows:
            p, _ = normalize(text or "")
            if len(p) >= 2 * Q:
                self.ids.append(item)
                self.points.append(p)
            elif len(p):
                self.short.append((item, p.tobytes().decode("utf-32-le", "surrogatepass")))
        grams = [qgrams(p) for p in self.points]
        sizes = np.array([len(g) for g in grams], np.int64)
        self.item = np.repeat(np.arange(len(grams)), sizes)
        self.at = np.concatenate([np.arange(n) for n in sizes]) if len(grams) else np.empty(0, np.int64)
        h = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.item, self.at = self.item[order], self.at[order]
        self.hashes, self.first = np.unique(h[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(h)))
        self.bloom = np.zeros(1 << BLOOM_BITS, bool)
        self.bloom[(self.hashes & np.uint64((1 << BLOOM_BITS) - 1)).astype(np.int64)] = True
        self.size = np.array([len(p) for p in self.points], np.int64)

    def hits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text place, row of ``hashes``) of q-grams that the block has."""
        h = qgrams(points)
        maybe = np.flatnonzero(self.bloom[(h & np.uint64((1 << BLOOM_BITS) - 1)).astype(np.int64)])
        if not len(maybe):
            return maybe, maybe
        row = np.searchsorted(self.hashes, h[maybe])
        row[row == len(self.hashes)] = 0
        good = self.hashes[row] == h[maybe]
        return maybe[good], row[good]


def bound(size: int) -> tuple[int, int, int]:
    """(window, edits, least shared q-grams) for an item of ``size``."""
    window = min(WINDOW, size)
    edits = int(ERROR * window)
    return window, edits, max(1, window - Q + 1 - Q * edits)


def regions(items: Items, points: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Candidate (item, text from, text to, least and greatest diagonal) stretches."""
    place, row = items.hits(points)
    if len(place) == 0:
        return []
    total = int(items.count[row].sum())
    if total > HITS and len(points) > 8 * WINDOW:
        half = len(points) // 2
        left = regions(items, points[: half + 2 * WINDOW])
        right = regions(items, points[half - 2 * WINDOW :])
        shift = half - 2 * WINDOW
        return left + [(k, a + shift, b + shift, lo + shift, hi + shift) for k, a, b, lo, hi in right]
    n = items.count[row]
    text = np.repeat(place, n)
    source = np.repeat(items.first[row], n) + np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    item, diagonal = items.item[source], text - items.at[source]
    step = max(1, int(ERROR * WINDOW))
    out = []
    band = (diagonal + (1 << 40)) // step
    for shift in (0, 1):  # bands of two steps, overlapping by one
        key = (band + shift) // 2
        order = np.argsort(item * (1 << 42) + key, kind="stable")  # in text order already
        k, t, i, d = key[order], text[order], item[order], diagonal[order]
        edge = np.flatnonzero((np.diff(k) != 0) | (np.diff(i) != 0)) + 1
        for a, b in zip(np.concatenate(([0], edge)), np.concatenate((edge, [len(k)]))):
            window, edits, least = bound(int(items.size[i[a]]))
            if b - a < least:
                continue
            p = t[a:b]
            full = np.flatnonzero(p[least - 1 :] - p[: b - a - least + 1] <= window - Q + edits)
            if not len(full):
                continue
            cuts = np.flatnonzero(p[full[1:]] > p[full[:-1] + least - 1] + Q) + 1
            for part in np.split(full, cuts):
                lo, hi = a + part[0], a + part[-1] + least
                dd = d[lo:hi]
                out.append((int(i[a]), int(t[lo]), int(t[hi - 1]) + Q, int(dd.min()), int(dd.max())))
    return out


def _banded(item: np.ndarray, text: np.ndarray, first: int, low: int, high: int, match: int, edit: int, local: bool):
    """Rows of a banded alignment of ``item``, whose first character stands at ``first``: (row, score, item start, text start, edits).

    The rows' cells are the diagonals (text place - item place) from ``low`` to ``high``; each row is a
    few array operations. A cell prefers the diagonal, then leaving an item character out, then text
    characters. A local alignment starts anew where its score is not above zero and takes no cell
    outside the text; else every diagonal starts once, and places outside the text match nothing.
    """
    width = high - low + 1
    k = np.arange(width)
    steps = edit * k
    from_ = first + low
    place = np.arange(from_, from_ + len(item) + width)
    within = (place >= 0) & (place < len(text))
    values = np.where(within, text[np.clip(place, 0, max(0, len(text) - 1))].astype(np.int64), -1) if len(text) else np.full(len(place), -1)
    score, edits = np.zeros(width, np.int64), np.zeros(width, np.int64)
    a, b = np.full(width, first), from_ + k
    for j, c in enumerate(item.tolist(), first):
        at = j - first
        if local:
            new = score <= 0
            a, b, edits, score = np.where(new, j, a), np.where(new, j + low + k, b), np.where(new, 0, edits), np.where(new, 0, score)
        same = values[at : at + width] == c
        best, e = score + np.where(same, match, -edit), edits + ~same
        source = k.copy()
        up = score[1:] - edit  # item character left out
        better = up > best[:-1]
        best[:-1][better] = up[better]
        e[:-1][better] = edits[1:][better] + 1
        source[:-1][better] += 1
        total = np.maximum.accumulate(best + steps) - steps  # text characters left out
        origin = np.maximum.accumulate(np.where(best == total, k, 0))
        edits = e[origin] + k - origin
        source = source[origin]
        a, b, score = a[source], b[source], total
        if local:
            score = np.where(within[at : at + width], score, 0)
        yield j, score, a, b, edits


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, first: int = 0) -> tuple[int, int, int, int, int] | None:
    """Best banded local alignment of ``item``, whose first character stands at ``first``: (item from, to, text from, to, edits).

    A match scores 1 and an edit costs 1 / (2 * ERROR), so a stretch may outgrow the error rate;
    the caller checks it. Diagonals (text place - item place) run from ``low`` to ``high``.
    """
    best, found = 0, None
    for j, score, a, b, edits in _banded(item, text, first, low, high, 1, int(1 / (2 * ERROR)), True):
        k = int(score.argmax())
        if score[k] > best:
            best, found = int(score[k]), (int(a[k]), j + 1, int(b[k]), j + low + k + 1, int(edits[k]))
    return found


def good_windows(item: np.ndarray, points: np.ndarray, lo: int, hi: int, low: int, high: int) -> np.ndarray:
    """Item places where a window starts that lies within its edits of some stretch of the text near ``lo`` to ``hi``.

    Edit distances of all windows at once; the stretch's ends are free within the diagonals ``low`` to
    ``high`` widened by the edits.
    """
    window, edits, _ = bound(len(item))
    low, width = low - edits, high - low + 2 * edits + 1
    first, last = max(0, lo - high - window - edits), min(len(item) - window, hi - low + edits)
    out = []
    for a in range(first, last + 1, 4096):
        n = min(4096, last + 1 - a)
        place = a + low + np.arange(n + window + width)
        inside = (place >= 0) & (place < len(points))
        text = np.where(inside, points[np.clip(place, 0, len(points) - 1)].astype(np.int64), -1)
        rows = np.lib.stride_tricks.sliding_window_view(text, width)
        cells, steps = np.zeros((n, width), np.int32), np.arange(width, dtype=np.int32)
        for j in range(window):
            new = cells + (rows[j : j + n] != item[a + j : a + j + n, None])
            np.minimum(new[:, :-1], cells[:, 1:] + 1, out=new[:, :-1])  # item character left out
            cells = (np.minimum.accumulate(new - steps, axis=1) + steps).astype(np.int32)  # text characters left out
        out.append(a + np.flatnonzero(cells.min(axis=1) <= edits))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def placed(item: np.ndarray, points: np.ndarray, start: int, low: int, high: int) -> tuple[int, int, int]:
    """(text from, text to, edits) of the stretch nearest to the whole of ``item``, which starts at ``start`` of its item."""
    for _, score, _, b, _ in _banded(item, points, start, low, high, 0, 1, False):
        pass
    k = int(score.argmax())
    return max(0, int(b[k])), min(len(points), start + len(item) + low + k), -int(score[k])


def windows_of(item: np.ndarray, points: np.ndarray, lo: int, hi: int, low: int, high: int) -> list[tuple[int, int, int, int, int]]:
    """(text from, text to, item from, item to, edits): runs of good windows within the rate, single windows of the others.

    Every good window overlaps one of the stretches.
    """
    window, edits, _ = bound(len(item))
    starts = good_windows(item, points, lo, hi, low, high)
    out = []
    for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1) if len(starts) else []:
        a, b = int(run[0]), int(run[-1]) + window
        i, j, e = placed(item[a:b], points, a, low - edits, high + edits)
        if e <= ERROR * (b - a):
            out.append((i, j, a, b, e))
            continue
        for a in range(a, b - window + 1, window):
            i, j, e = placed(item[a : a + window], points, a, low - edits, high + edits)
            out.append((i, j, a, a + window, e))
        if a + window < b:  # the last one ends the run
            i, j, e = placed(item[b - window : b], points, b - window, low - edits, high + edits)
            out.append((i, j, b - window, b, e))
    return out


def joined_regions(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Regions of an item that follow or overlap each other in the text, as one, while its diagonals span at most ``SPAN``."""
    out: list[tuple[int, int, int, int, int]] = []
    open_: list[tuple[int, int, int, int, int]] = []
    for k, lo, hi, d0, d1 in sorted(found):
        open_ = [r for r in open_ if r[0] == k and lo <= r[2] + WINDOW]
        r = next((r for r in open_ if max(d1, r[4]) - min(d0, r[3]) <= SPAN), None)
        if r is not None:
            open_.remove(r)
            out.remove(r)
            lo, hi, d0, d1 = r[1], max(hi, r[2]), min(d0, r[3]), max(d1, r[4])
        open_.append((k, lo, hi, d0, d1))
        out.append(open_[-1])
    return out


def stretches(items: Items, points: np.ndarray, region: tuple[int, int, int, int, int]) -> list[tuple]:
    """(item number, text from, text to, item from, item to, edits) of what a region holds.

    The item's part around the region is aligned in the region's band, for the longest stretch; where
    that does not hold the whole region, the region's own windows are compared. Bands have a bounded
    width, so the work is in proportion to the region's length.
    """
    k, lo, hi, d0, d1 = region
    item, found = items.points[k], []
    window, edits, _ = bound(len(item))
    if d0 == d1 and 0 <= d0 and d0 + len(item) <= len(points) and np.array_equal(points[d0 : d0 + len(item)], item):
        return [(k, d0, d0 + len(item), 0, len(item), 0)]  # the whole item as it is
    first = max(0, lo - d1 - edits - window)
    part = item[first : max(first, hi - d0 + edits + window)]
    base = max(0, first + d0 - edits)
    text = points[base : first + len(part) + d1 + edits + 1]
    got = align(part, text, d0 - edits - base, d1 + edits - base, first)
    if got is not None:
        a, b, i, j, e = got
        if b - a >= window - edits and e <= ERROR * max(b - a, window):
            found.append((k, base + i, base + j, a, b, e))
            if base + i <= lo and hi <= base + j:
                return found
    return found + [(k, *w) for w in windows_of(item, points, lo, hi, d0, d1)]


def verified(items: Items, points: np.ndarray) -> list[tuple]:
    """``stretches`` of all regions; of an item's overlapping ones that with the most characters after its edits, of equal ones the first in the text.

    Regions and stretches come in the order of what they can give at most (a stretch: what it gives), of
    equal ones by their place. So the next stretch beats all that follows and stands unless a better one
    overlaps it. What a region can give shrinks with the part of its text that no stretch covers yet; where
    less than a window is left, all that it could give overlaps what stands, and it is not aligned.
    """
    best: list[tuple] = []
    per_item: dict[int, list[tuple]] = {}
    for r in joined_regions(regions(items, points)):
        per_item.setdefault(r[0], []).append(r)
    for k in sorted(per_item):
        size = len(items.points[k])
        window, edits, _ = bound(size)
        margin = window + edits

        def key(r: tuple, free: int) -> tuple:
            most = min(free, size)
            return -most, r[1] if most == size else r[1] - margin, 0, r  # only a copy without edits gives its whole size

        heap = [key(r, r[2] - r[1] + 2 * margin) for r in per_item[k]]
        heapq.heapify(heap)
        taken: list[tuple[int, int]] = []  # places in the text, sorted
        seen = set()
        while heap:
            most, place, is_stretch, r = heapq.heappop(heap)
            if is_stretch:
                at = bisect.bisect_left(taken, (r[2],))
                if not at or taken[at - 1][1] <= r[1]:
                    taken.insert(at, (r[1], r[2]))
                    best.append(r)
                continue
            free = _free(taken, r[1], r[2], margin)
            if free < window - edits:
                continue
            if (again := key(r, free))[0] > most:
                heapq.heappush(heap, again)
            else:
                for s in stretches(items, points, r):
                    if s not in seen:
                        seen.add(s)
                        heapq.heappush(heap, (s[5] - (s[4] - s[3]), s[1], 1, s))
    return best


def _free(taken: list[tuple[int, int]], lo: int, hi: int, margin: int) -> int:
    """Length of the longest part outside the sorted, disjoint stretches that reaches into ``lo`` to ``hi``, and beyond by ``margin`` at most."""
    start, end, longest = lo - margin, hi + margin, 0
    at = max(0, bisect.bisect_left(taken, (start,)) - 1)
    while at < len(taken) and taken[at][0] < end and start < hi:
        if taken[at][0] > lo:
            longest = max(longest, taken[at][0] - start)
        start = max(start, taken[at][1])
        at += 1
    return max(longest, end - start) if start < hi else longest


def _short(items: Items, points: np.ndarray) -> list[tuple]:
    if not items.short:
        return []
    text = " " + points.tobytes().decode("utf-32-le", "surrogatepass") + " "
    out = []
    for k, (_, s) in enumerate(items.short):
        at = text.find(f" {s} ")
        while at >= 0:
            out.append((-1 - k, at, at + len(s), 0, len(s), 0))
            at = text.find(f" {s} ", at + 1)
    return out


def find_regions(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Verified stretches of documents that repeat benchmark items; see ``REGIONS``.

    Document places count code points of the text as given, item places those of the compared form.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    out = None
    for name, block in _blocks(benchmark, item_id, item_text):
        part = rows.mapInArrow(_finder(name, block), REGIONS)
        out = part if out is None else out.unionByName(part)
    return out


def _blocks(benchmark: DataFrame, item_id: str, item_text: str) -> Iterator[tuple[str, Broadcast]]:
    """Items with text in broadcast blocks of about ``BLOCK_CHARS`` characters, each with a name; one empty block of an empty benchmark."""
    bench = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text")).where("length(text) > 0")
    total = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_CHARS))
    for b in range(blocks):
        rows = [tuple(r) for r in bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]
        yield uuid.uuid4().hex, sized_broadcast(benchmark.sparkSession, pickle.dumps(rows), BLOCK_BYTES)


#: The block that a worker looked at last, with its index.
_INDEX: dict[str, Items] = {}


def _indexed(name: str, block: Broadcast) -> Items:
    if name not in _INDEX:
        _INDEX.clear()
        _INDEX[name] = Items(pickle.loads(block.value))
    return _INDEX[name]


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", short_items: bool = False) -> DataFrame:
    """Rows of ``docs`` whose text has no verified region.

    Items below twice q hold a word or two, so they don't count here unless ``short_items`` asks for it.
    """
    for name, block in _blocks(benchmark, item_id, item_text):
        docs = docs.where(_clean(name, block, short_items)(F.col(f"`{text}`")))
    return docs


def _clean(name: str, block: Broadcast, short_items: bool):
    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        items, out = _indexed(name, block), []
        for t in texts:
            points, _ = normalize(t.as_py() or "")
            out.append(not verified(items, points) and not (short_items and _short(items, points)))
        return tidied(pa.array(out, pa.bool_()))

    return clean


def _finder(name: str, block: Broadcast):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _indexed(name, block)
        for batch in batches:
            out = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                points, place = normalize(t.as_py() or "")
                for k, i, j, a, b, e in verified(items, points) + _short(items, points):
                    item, size = (items.ids[k], len(items.points[k])) if k >= 0 else (items.short[-1 - k][0], b)
                    out.append((doc, item, int(place[i]), int(place[j - 1]) + 1, a, b, e, (b - a) / size))
            cols = list(zip(*out)) or [[]] * 8
            kinds = (*[pa.int64()] * 7, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in REGIONS.split(", ")])

    return find
