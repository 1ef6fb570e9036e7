"""Operator 11: spelling variants, by forward and backward minimal acyclic automata.

A word and another that differs from it by one inserted, deleted or replaced code point agree
exactly in the first or in the last half of the word. So words meet by halves: a forward automaton
matches the first half exactly and completes the rest with one error, a backward automaton (of the
reversed words) does the same from the end. Both are minimal and count the words below every
transition, so a path's sum is the word's number, which gives its count. What both find is one pair.

How it scales: a word's row goes to the halves that it may share with a word one shorter, alike in
length or one longer; rows are dealt by half, and a task builds the automata of its rows alone. A
half that more than ``HOT`` rows share is split before that: the window that holds the error is cut
in two, and what lies outside the part with the error must match as well, from both sides. After
enough cuts the window is one letter, and a group is bounded by the alphabet. No group is cut off,
and no pairs within a group are formed but those that the automata find.

Defined results: a null text has no words, a null id counts as the empty text in the choice of
deleted letters, repeated rows count each time. Words of any length are kept whole. Of equal counts
the form that is first in code-point order is taken. Only id and text are read, so other columns
can't clash; empty tables give no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize, scope, shared_dir, small

#: Letters of a run, a fixed value; only A to Z are lower-cased.
LETTERS = "A-Za-zÀ-ÿ"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Least code points and occurrences of a word; a form occurs so many times as often at least; one run of so many loses a letter.
LEAST, OFTEN, TIMES, ONE_IN = 6, 5, 5, 199
#: Rows that may share a half before it is split, and rows that one task should have.
HOT, ROWS = 10_000, 60_000
#: Most rows of tables (hot halves, forms) that are broadcast.
BROADCAST_KEYS = 200_000

KEYS = "backward boolean, head string, tail string, window int, word string, n long"
PAIRS = "word string, n long, near string, near_n long"


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, often: int = OFTEN, one_in: int = ONE_IN) -> DataFrame:
    """(word, n): runs of letters in lower case, of which one in ``one_in`` lost a letter by its hash with the id."""
    found = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    ascii_only = F.octet_length("run") == F.length("run")
    low = runs.select("id", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", UPPER, UPPER.lower())).alias("run"))
    coded = low.select("run", F.length("run").alias("size"), F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.col("size")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("size")))
    words = coded.select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


class Automaton:
    """Minimal acyclic automaton of sorted, distinct words, each of which has its place among them as its number."""

    def __init__(self, words: list[str]):
        #: Of each state its transitions, letter -> (state, words before it), whether a word ends there, and its number of words.
        self.steps: list[dict[str, tuple[int, int]]] = []
        self.ends: list[bool] = []
        self.count: list[int] = []
        self._known: dict[tuple, int] = {}
        before, path = "", [[False, {}]]
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            self._close(path, before, shared)
            path.extend([False, {}] for _ in range(len(word) - shared))
            path[-1][0] = True
            before = word
        self._close(path, before, 0)
        self.root = self._state(*path[0])
        self._known.clear()

    def _close(self, path: list, word: str, keep: int) -> None:
        """States of the last word beyond ``keep`` letters are complete: each becomes a known one that is alike, or a new one."""
        while len(path) > keep + 1:
            state = self._state(*path.pop())
            path[-1][1][word[len(path) - 1]] = state

    def _state(self, end: bool, to: dict[str, int]) -> int:
        alike = (end, *to.items())
        state = self._known.get(alike)
        if state is None:
            state = self._known[alike] = len(self.steps)
            total, steps = int(end), {}
            for letter, child in to.items():
                steps[letter] = (child, total)
                total += self.count[child]
            self.steps.append(steps)
            self.ends.append(end)
            self.count.append(total)
        return state

    def number(self, word: str, state: int | None = None, total: int = 0) -> int:
        """The word's number, or -1; with ``state`` and ``total`` that of the rest of a word from there."""
        state = self.root if state is None else state
        steps = self.steps
        for letter in word:
            step = steps[state].get(letter)
            if step is None:
                return -1
            state, total = step[0], total + step[1]
        return total if self.ends[state] else -1

    def one_error(self, word: str, first: int, last: int) -> set[int]:
        """Numbers of words that are ``word`` with one letter inserted, deleted or replaced at the places ``first`` to ``last``; the rest is exact."""
        steps, found, state, total = self.steps, set(), self.root, 0
        for letter in word[:first]:
            step = steps[state].get(letter)
            if step is None:
                return found
            state, total = step[0], total + step[1]
        size = len(word)
        for i in range(first, last + 1):
            own = word[i] if i < size else None
            here, rest, after = steps[state], word[i:], word[i + 1 :]
            for letter, (child, skipped) in here.items():
                # a letter inserted before one of its kind is the same as after it
                if letter != own or i == last:
                    found.add(self.number(rest, child, total + skipped))
                if letter != own and i < last:
                    found.add(self.number(after, child, total + skipped))
            if i < last:
                if i + 1 == last or after[0] != own:
                    found.add(self.number(after, state, total))
                step = here.get(own)
                if step is None:
                    break
                state, total = step[0], total + step[1]
        found.discard(-1)
        return found


def _keys(words: DataFrame, least: int) -> DataFrame:
    """Rows ``KEYS``: each word by the halves of words of ``least`` letters or more that it may stand for: one shorter, alike, one longer.

    ``window`` is the length of that other word's part with the error, ``head`` and ``tail`` the parts
    around it. A row asks for its neighbours where the three add up to the word's own length.
    """
    size = F.length("word")
    keys = []
    for more in (-1, 0, 1):
        length = size + more
        half = F.floor(length / 2).cast("int")
        for backward in (False, True):
            keys.append(
                F.struct(
                    length.alias("length"),
                    F.lit(backward).alias("backward"),
                    (F.lit("") if backward else F.left("word", half)).alias("head"),
                    (F.right("word", length - half) if backward else F.lit("")).alias("tail"),
                    (half if backward else length - half).cast("int").alias("window"),
                )
            )
    rows = words.select("word", "n", F.explode(F.array(*keys)).alias("k")).where(F.col("k.length") >= least)
    return rows.select("k.backward", "k.head", "k.tail", "k.window", "word", "n")


def _split(rows: DataFrame) -> DataFrame:
    """Each row twice: the error in the first or in the second half of its window."""
    a, half = F.length("head"), F.floor(F.col("window") / 2).cast("int")
    first = F.struct(F.col("head").alias("head"), F.right("word", F.length("tail") + F.col("window") - half).alias("tail"), half.alias("window"))
    second = F.struct(F.left("word", a + half).alias("head"), F.col("tail").alias("tail"), (F.col("window") - half).alias("window"))
    cut = rows.select("backward", "word", "n", F.explode(F.array(first, second)).alias("k"))
    return cut.select("backward", "k.head", "k.tail", "k.window", "word", "n")


def _spread(rows: DataFrame, hot: int) -> DataFrame:
    """``rows`` (a written table) with windows cut until at most ``hot`` rows share what is around them, or the window is one letter."""
    group = ["backward", "head", "tail"]
    while True:
        crowded = materialize(rows.where("window > 1").groupBy(*group).count().where(F.col("count") > hot).select(*group), "crowded")
        if crowded.limit(1).count() == 0:
            discard(crowded)
            return rows
        held = rows.join(small(crowded.withColumn("hot", F.lit(True)), BROADCAST_KEYS), group, "left")
        cut = F.col("hot").isNotNull() & (F.col("window") > 1)
        columns = rows.columns
        finer = materialize(held.where(~cut).select(*columns).unionByName(_split(held.where(cut).select(*columns))), "keys")
        discard(rows, crowded)
        rows = finer


def near_pairs(words: DataFrame, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """``PAIRS``: each word of ``words`` (word, n) with each word that differs by one code point; a pair may come twice."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        for backward in (False, True):
            turned = (lambda w: w[::-1]) if backward else (lambda w: w)
            own = [r for r in rows if r[0] == backward]
            counts = {turned(word): n for *_, word, n in own}
            ordered = sorted(counts)
            automaton = Automaton(ordered)
            out: list[tuple] = []
            for _, head, tail, window, word, n in own:
                if len(head) + window + len(tail) == len(word):
                    first = len(tail if backward else head)
                    for k in automaton.one_error(turned(word), first, first + window):
                        out.append((word, n, turned(ordered[k]), counts[ordered[k]]))
                if len(out) >= 4096:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    bounded_batches(words.sparkSession)
    rows = _spread(materialize(_keys(words, least), "keys"), hot)
    tasks = -(-rows.count() // ROWS) or 1
    return rows.repartition(tasks, "backward", "head", "tail").mapInArrow(find, PAIRS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=["word", "n", "near", "near_n"])


def with_forms(words: DataFrame, pairs: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n): the near word of largest count, if that is ``times`` the word's own at least."""
    alone = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    distinct = pairs.unionByName(alone).repartition("word").groupBy("word", "near").agg(F.max("n").alias("n"), F.max("near_n").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))))
    found = distinct.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.minus") >= times * F.col("n")
    return found.select("word", "n", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n"))


def with_roots(forms: DataFrame) -> DataFrame:
    """``forms`` (a written table) with ``root``: the end of each word's chain of forms. Counts grow along a chain, so it ends; rounds double the step."""
    rows = forms.where("form is not null").select("word", F.col("form").alias("root"))
    rows = materialize(rows, "roots")
    while True:
        onward = small(rows.select(F.col("word").alias("root"), F.col("root").alias("beyond")), BROADCAST_KEYS)
        moved = materialize(rows.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        discard(rows)
        rows = moved
        if rows.where("moved").limit(1).count() == 0:
            break
    return forms.join(small(rows.select("word", "root"), BROADCAST_KEYS), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variant_groups(words: DataFrame, least: int = LEAST, times: int = TIMES, hot: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``words`` (word, n), which are distinct and have ``least`` code points or more."""
    spark = words.sparkSession
    path = shared_dir(spark, "forms")
    with scope(spark, "variants"):  # words and keys go when the forms are there
        words = materialize(words.select("word", "n"), "words")
        forms = materialize(with_forms(words, near_pairs(words, least, hot), times), "forms", path)
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")

