"""Operator 2: toxicity by a lexicon trie, Levenshtein automata and context windows.

Terms (whole words, and stems that start a word) are learned from document frequencies in
labelled rows. Words of a text run through a deterministic automaton made lazily from the
states (trie node, edits) of the Levenshtein automaton intersected with the lexicon trie, so
one walk finds exact terms, stems and misspellings (of the first letter in long terms, or where
a digit stands for it). A
misspelling doesn't count where its counts in toxic and clean training texts speak against a
term's odds. The window around a match tells quotation (quotation marks within ``MARKS`` characters
on its line, reporting words within ``WINDOW`` words) from abuse (address in the second person). A logistic model turns the
windows' sums into a score; its rows are extended by the same rows with every match
misspelled (still toxic) and with every match quoted (not toxic).

Labels, language, source and ids never enter a score.

Defined results: null text counts as empty; an empty text gets the score of a text without
matches; texts of any length are read whole. Several labels of one id count as toxic if one is; null labels are left out. Copies
of a text count once in training. Without labelled rows of both kinds every score is 0.
Extra columns pass through. All terms and innocent spellings that qualify are held; beyond
``LEXICON_BYTES`` and the other byte bounds fitting fails instead of leaving any out.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clash_free, id_bucket, materialize, small, tidied

#: A term occurs in at least so many toxic texts, with at least this log odds ratio and G-test value
#: (the latter holds the expected number of chance terms among a million candidates below 0.01).
LEAST_TOXIC, LEAST_ODDS, LEAST_G = 4, 3.0, 37.0
#: G-test value (a chance of 1 %) from which a misspelling's counts are innocent.
INNOCENT_G = 6.63
#: UTF-8 bytes of candidate terms, of the lexicon and of innocent spellings that may be held; more are refused.
CANDIDATE_BYTES, LEXICON_BYTES, INNOCENT_BYTES = 32 << 20, 1 << 20, 16 << 20
#: Stems have so many letters; terms of so many letters may be misspelled.
STEM, FUZZY = (4, 8), 5
#: Terms of so many letters may be misspelled in the first one too; shorter ones only by a digit.
FIRST = 7
#: Labelled rows that the logistic model is fitted on, at most (about; picked by a hash of the text).
FIT_ROWS = 20_000
#: Most (id, hash, label) rows that are broadcast, about 40 bytes each.
BROADCAST_ROWS = 400_000
#: Bits (as a power of two) of the map of toxic terms.
BITMAP = 20
#: Entries of a task's counts before they are passed on.
PARTIAL = 150_000
REMEMBERED = 120_000
#: The window around a match: words, and characters in which an opening and a closing quotation mark are looked for.
WINDOW, MARKS = 6, 80
THRESHOLD = 0.7

WORD = re.compile(r"[^\W_]+")
OPEN = re.compile("[\"“„«‘][^\"”»’\\n]*$")
CLOSE = re.compile("^[^\"“„«‘\\n]*[\"”»’“]")
REPORT = {*"said says say wrote writes quote quoted quotes called calls word term slur dit écrit appelle mot sagte schrieb nannte wort dijo escribió llamó palabra".split()}
ADDRESS = {*"you your yours youre yourself u ur tu te toi vous votre du dich dir dein deine ihr euch tú ti usted ustedes vosotros".split()}
FEATURES = ("plain", "quoted", "fuzzy", "fuzzy_quoted", "address", "strongest", "density")


class Lexicon:
    """Terms with weights behind a lazily determinised automaton of at most one edit."""

    def __init__(self, terms: list[tuple[str, bool, float]], innocent: set[str] = frozenset()):
        self.terms, self.innocent = terms, innocent
        self.children: list[dict[str, int]] = [{}]
        self.whole: list[int] = [-1]
        self.stem: list[int] = [-1]
        for k, (term, whole, _) in enumerate(terms):
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.whole.append(-1)
                    self.stem.append(-1)
                node = self.children[node][c]
            (self.whole if whole else self.stem)[node] = k
        self._reset()

    def _reset(self) -> None:
        start = self._close({(0, 0)})
        self.states: list[frozenset] = [start]
        self.number = {start: 0}
        self.moves: list[dict[str, int]] = [{}]

    def _close(self, state: set) -> frozenset:
        """Adds the states that skip a letter of the term; keeps the fewest edits of a node."""
        best: dict[int, int] = {}
        for node, e in state:
            best[node] = min(e, best.get(node, 2))
        for node, e in list(best.items()):
            if e == 0:
                for child in self.children[node].values():
                    best.setdefault(child, 1)
        return frozenset(best.items())

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.states[state]:
            for x, child in self.children[node].items():
                if x == c:
                    out.add((child, e))
                elif e == 0:
                    out.add((child, 1))
            if e == 0:
                out.add((node, 1))
        new = self._close(out)
        if new not in self.number:
            if len(self.states) > 200_000:
                self._reset()
                return -1
            self.number[new] = len(self.states)
            self.states.append(new)
            self.moves.append({})
        self.moves[state][c] = self.number[new]
        return self.number[new]

    @staticmethod
    def may_be(word: str, term: str) -> bool:
        """Whether an edit of the first letter is taken for a misspelling: in a long term, or where the word starts with a digit."""
        return word[0] == term[0] or len(term) >= FIRST or word[0].isdigit()

    def match(self, word: str) -> tuple[int, bool] | None:
        """(term, misspelled) of the best match of ``word``: exact, stem, then misspelled.

        Of several misspelled terms the one of the greatest weight is taken, of equal weights the first term.
        """
        state, stem, near = 0, -1, set()
        for c in word:
            to = self.moves[state].get(c)
            if to is None:
                to = self._step(state, c)
                if to < 0:  # the automaton started anew
                    return self.match(word)
            state = to
            if not self.states[state]:
                break
            for node, e in self.states[state]:
                k = self.stem[node]
                if k >= 0 and e == 0:
                    stem = k
                elif k >= 0 and len(self.terms[k][0]) > FUZZY:
                    near.add(k)
        else:
            for node, e in self.states[state]:
                k = self.whole[node]
                if k >= 0 and e == 0:
                    return k, False
                if k >= 0 and len(self.terms[k][0]) >= FUZZY:
                    near.add(k)
        if stem >= 0:
            return stem, False
        near = [k for k in near if self.may_be(word, self.terms[k][0])]
        return (max(near, key=lambda k: (self.terms[k][2], -k)), True) if near and word not in self.innocent else None


class Scorer:
    """Features of texts; remembers which words match."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.known: set[str] = set()
        self.hits: dict[str, tuple[int, bool]] = {}

    def _look(self, distinct: set[str]) -> None:
        """Match the words that were not seen yet."""
        new = distinct - self.known
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            self.hits.clear()
            new = distinct
        for w in new:
            if (m := self.lexicon.match(w)) is not None:
                self.hits[w] = m
        self.known |= new

    def misspelled(self, text: str) -> list[str]:
        """Distinct words that would count as misspelled terms."""
        distinct = set(WORD.findall(text.lower()))
        self._look(distinct)
        return [w for w in distinct & self.hits.keys() if self.hits[w][1]]

    def features(self, text: str) -> list[float]:
        low = text.lower()
        words = WORD.findall(low)
        distinct = set(words)
        self._look(distinct)
        if self.hits.keys().isdisjoint(distinct):
            return [0.0] * len(FEATURES)
        sums, address, strongest, count = [0.0] * 4, 0, 0.0, 0
        for k, m in enumerate(WORD.finditer(low)):
            hit = self.hits.get(m[0])
            if hit is None:
                continue
            term, fuzzy = hit
            weight = self.lexicon.terms[term][2]
            around = words[max(0, k - WINDOW) : k] + words[k + 1 : k + 1 + WINDOW]
            quoted = bool(OPEN.search(low[max(0, m.start() - MARKS) : m.start()]) and CLOSE.search(low[m.end() : m.end() + MARKS]))
            quoted = quoted or not REPORT.isdisjoint(around)
            sums[2 * fuzzy + quoted] += weight
            address += not quoted and not ADDRESS.isdisjoint(around)
            strongest = max(strongest, 0.0 if quoted else weight)
            count += not quoted
        return [*np.log1p(sums).tolist(), float(np.log1p(address)), strongest, float(np.log1p(100 * count / len(words)))]


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Weights and intercept by Newton's method with an L2 penalty."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + penalty * beta
        hess = (x * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5 / max(1e-12, float(np.abs(step).max())))
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def augment(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, labels and weights with every toxic row also misspelled (toxic) and quoted (clean)."""
    toxic = x[(y == 1) & (x[:, 0] > 0)]
    fuzzy, quoted = toxic.copy(), np.zeros_like(toxic)
    fuzzy[:, 2], fuzzy[:, 0] = toxic[:, 0], 0
    quoted[:, 1] = toxic[:, 0]
    both = np.concatenate([x, fuzzy, quoted])
    return both, np.concatenate([y, np.ones(len(toxic)), np.zeros(len(toxic))]), np.concatenate([np.ones(len(x)), np.full(2 * len(toxic), 0.5)])


def choose_terms(rows: list[tuple[str, bool, float, float]]) -> list[tuple[str, bool, float]]:
    """Terms by G value; along a trie path only the best one stays (of equals the longest)."""
    taken, kept, covered = [], set(), set()  # terms, their spellings, and all beginnings of those
    for term, whole, odds, _ in sorted(rows, key=lambda r: (-r[3], -len(r[0]), not r[1], r[0])):
        spelled = term + "$" * whole
        paths = {spelled[:k] for k in range(1, len(spelled) + 1)}
        if spelled in covered or not paths.isdisjoint(kept):
            continue
        taken.append((term, whole, round(min(odds, 8.0), 6)))
        kept.add(spelled)
        covered |= paths
    _refuse(sum(len(t.encode()) for t, _, _ in taken), LEXICON_BYTES, "lexicon terms")
    return taken


def _refuse(size: int, most: int, what: str) -> None:
    if size > most:
        raise ValueError(f"{size} bytes of {what}; at most {most} can be held, and none are left out")


def _held(df: DataFrame, most: int, name: str) -> list:
    """All rows of ``df`` with the terms' bytes checked first."""
    df = materialize(df, name)
    _refuse(df.agg(F.sum(F.octet_length("term"))).first()[0] or 0, most, name)
    return df.collect()


def _terms_of(text: str) -> set[str]:
    """Words (with a closing sign) and stems of a text."""
    low, high = STEM
    seen = set()
    for w in set(WORD.findall(text.lower())):
        if len(w) >= 3:
            seen.add(w + "$")
            for k in range(low, min(len(w), high + 1)):
                seen.add(w[:k])
    return seen


def _counter(of, schema: str = "term string, n long"):
    """A task's counts of what ``of(text)`` gives, flushed at ``PARTIAL`` entries."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])
            counts.clear()
            return tidied(out)

        for batch in batches:
            for text in batch.column(0):
                counts.update(of(text.as_py() or ""))
                if len(counts) > PARTIAL:
                    yield flush()
        yield flush()

    return lambda rows: rows.select("text").mapInArrow(count, schema).groupBy("term").agg(F.sum("n").alias("n"))


def innocent(toxic: int, clean: int):
    """Whether a row's counts (of so many texts) are too clean for a word of the odds ``LEAST_ODDS``, by a G-test."""
    share = toxic * math.exp(LEAST_ODDS) / (toxic * math.exp(LEAST_ODDS) + clean)  # toxic texts among those of such a word
    both = F.col("toxic") + F.col("clean")
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    return (F.col("toxic") < both * share) & (2 * (part(F.col("toxic"), both * share) + part(F.col("clean"), both * (1 - share))) >= INNOCENT_G)


class ToxicityModel:
    def __init__(self, lexicon: Lexicon, beta: np.ndarray):
        self.lexicon, self.beta = lexicon, beta

    @staticmethod
    def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """(text, toxic) of labelled rows outside the held-out third, each text once.

        Only ids, hashes and labels are shuffled; texts are read again where they are needed.
        """
        marks = labels.where("toxic is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
        rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
        rows = rows.where(id_bucket(F.col("id"), 3) != 1)
        code = F.unhex(F.sha1(F.col("text").cast("binary")))
        marked = rows.select("id", code.alias("code")).join(small(materialize(marks, "toxic-marks"), BROADCAST_ROWS), "id")
        kept = marked.groupBy("code").agg(F.min("id").alias("id"), (F.max("toxic") > 0).cast("int").alias("toxic"))
        kept = small(materialize(kept, "toxic-kept"), BROADCAST_ROWS)
        return rows.join(kept, "id").where(F.col("code") == code).select("text", "toxic")

    @classmethod
    def fit(cls, rows: DataFrame) -> ToxicityModel:
        """Learn from (text, toxic 0/1) rows."""
        sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
        toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
        if not toxic or not clean:
            return cls(Lexicon([]), np.array([0.0] * len(FEATURES) + [-30.0]))
        # terms of toxic texts first; clean texts then count only terms that a bitmap of those may hold
        seen = materialize(_counter(_terms_of)(rows.where("toxic = 1")).where(F.col("n") >= LEAST_TOXIC), "toxic-terms")
        bits = np.zeros(1 << BITMAP, bool)
        bits[seen.select((F.crc32(F.col("term").cast("binary")) % (1 << BITMAP)).alias("bit")).distinct().toPandas()["bit"].to_numpy(np.int64)] = True
        packed = np.packbits(bits).tobytes()
        held: list[np.ndarray] = []

        def known(text: str) -> list[str]:
            if not held:
                held.append(np.unpackbits(np.frombuffer(packed, np.uint8)).tobytes())
            return [t for t in _terms_of(text) if held[0][zlib.crc32(t.encode()) & (1 << BITMAP) - 1]]

        others = _counter(known)(rows.where("toxic = 0")).withColumnRenamed("n", "clean")
        counts = seen.withColumnRenamed("n", "toxic").join(others, "term", "left").withColumn("clean", F.coalesce("clean", F.lit(0)))
        counts = counts.select(F.regexp_replace("term", "[$]", "").alias("term"), F.col("term").endswith("$").alias("whole"), "toxic", "clean")
        p, q = (F.col("toxic") + 0.5) / (toxic + 1), (F.col("clean") + 0.5) / (clean + 1)
        odds = F.log(p / (1 - p)) - F.log(q / (1 - q))
        share, both = toxic / (toxic + clean), F.col("toxic") + F.col("clean")
        part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
        g = 2 * (
            part(F.col("toxic"), both * share)
            + part(F.col("clean"), both * (1 - share))
            + part(toxic - F.col("toxic"), (toxic + clean - both) * share)
            + part(clean - F.col("clean"), (toxic + clean - both) * (1 - share))
        )
        ranked = counts.where(F.col("toxic") >= LEAST_TOXIC).select("term", "whole", odds.alias("odds"), g.alias("g"))
        ranked = ranked.where((F.col("odds") >= LEAST_ODDS) & (F.col("g") >= LEAST_G))
        terms = choose_terms([tuple(r) for r in _held(ranked, CANDIDATE_BYTES, "toxic-candidates")])

        lexicon: list[Scorer] = []

        def misspelled(text: str) -> list[str]:
            if not lexicon:
                lexicon.append(Scorer(Lexicon(terms)))
            return lexicon[0].misspelled(text)

        near = _counter(misspelled)(rows.where("toxic = 0")).withColumnRenamed("n", "clean")
        caught = _counter(misspelled)(rows.where("toxic = 1")).withColumnRenamed("n", "toxic")
        near = near.join(caught, "term", "left").withColumn("toxic", F.coalesce("toxic", F.lit(0))).where(innocent(toxic, clean))
        model = cls(Lexicon(terms, {r["term"] for r in _held(near.select("term"), INNOCENT_BYTES, "toxic-innocent")}), np.zeros(len(FEATURES) + 1))
        share = min(1.0, FIT_ROWS / (toxic + clean))
        picked = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
        data = np.array([[*r["features"], r["toxic"]] for r in picked.select(model.features("text").alias("features"), "toxic").collect()])
        x, y, w = augment(data[:, :-1], data[:, -1])
        model.beta = fit_logistic(x, y, w)
        return model

    def features(self, text: str):
        lexicon = self.lexicon
        held: list[Scorer] = []

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def features(texts: pa.Array) -> pa.Array:
            if not held:
                held.append(Scorer(lexicon))
            return tidied(pa.array([held[0].features(t.as_py() or "") for t in texts], pa.list_(pa.float64())))

        return features(F.col(f"`{text}`"))

    def score(self, df: DataFrame, text: str = "text", score: str = "score") -> DataFrame:
        """``df`` with a score between 0 and 1."""
        made = clash_free(df, "toxic_features")
        terms = [F.col(made)[k] * float(b) for k, b in enumerate(self.beta[:-1])]
        logit = F.lit(float(self.beta[-1]))
        for t in terms:
            logit = logit + t
        scored = df.withColumn(made, self.features(text)).withColumn(score, 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), logit)))))
        return scored.drop(made)
