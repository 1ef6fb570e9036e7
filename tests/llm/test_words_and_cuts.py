"""Spelling variants, shards and fill-in-middle against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandweave.llm import fill_middle, sharding, variants

# --- spelling variants


def _plain_words(rows, least=6, often=5, one_in=199):
    counts = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-z\xc0-\xff]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % one_in == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= least:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= often}


def _one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def _plain_variants(words, times=5):
    form, out = {}, {}
    for w, n in words.items():
        near = [x for x in words if _one_apart(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
        out[w] = (n, len(near))
    found = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        found.add((w, form[w], root, *out[w], words.get(form[w])))
    return found


def _got(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


WORDS = st.text("abé", min_size=1, max_size=7)


@settings(max_examples=200, deadline=None)
@given(st.sets(WORDS, min_size=1, max_size=40), WORDS, st.data())
def test_automaton_numbers_and_one_error(words, asked, data):
    ordered = sorted(words)
    automaton = variants.Automaton(ordered)
    assert [automaton.number(w) for w in ordered] == list(range(len(ordered)))
    assert automaton.number(asked) == (ordered.index(asked) if asked in words else -1)
    rests = {tuple(sorted(w[len(p) :] for w in words if w.startswith(p))) for v in words for p in (v[:k] for k in range(len(v) + 1))}
    assert len(automaton.steps) == len(rests)  # a state for each set of endings: the least number
    assert automaton.one_error(asked, 0, len(asked)) == {k for k, w in enumerate(ordered) if _one_apart(asked, w)}
    first = data.draw(st.integers(0, len(asked)))
    exact = {k for k, w in enumerate(ordered) if _one_apart(asked, w) and any(w[:i] == asked[:i] for i in (first,))}
    assert automaton.one_error(asked, first, len(asked)) <= exact


@pytest.mark.parametrize("hot", [2, 10, 10_000])
def test_variants_equal_brute_force(spark, hot):
    rng = random.Random(hot)
    words = {"".join(rng.choice("ab") for _ in range(rng.choice((6, 6, 7, 8, 9)))): rng.choice((5, 6, 30, 200, 5000)) for _ in range(150)}
    words |= {"prefix" + "".join(rng.choice("xyz") for _ in range(rng.choice((3, 4)))): rng.choice((5, 30, 900)) for _ in range(60)}
    words |= {"a" * k: 5**k for k in (6, 7, 8, 9)} | {"\xe9" * 3 + "\xff\xd7\xf7": 7, "\xe9" * 2 + "\xff\xd7\xf7": 7}
    words = {w: n for w, n in words.items() if len(w) >= 6}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert _got(variants.variant_groups(df, hot=hot)) == _plain_variants(words)


def test_word_counts_equal_plain_ones(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert {r["word"]: r["n"] for r in variants.count_words(odd_docs, often=1).collect()} == _plain_words(rows, often=1)
    mixed = [(d, "Variant VARIANT vari\xc9nt straße abc\xd7def x1ghijkl " * 7) for d in (*range(60), None)] + [(3, None), (4, ""), (5, "z" * 3000)]
    docs = spark.createDataFrame([(d, t, "w") for d, t in mixed], "doc_id long, text string, word string")
    words = variants.count_words(docs, one_in=3)
    assert {r["word"]: r["n"] for r in words.collect()} == _plain_words(mixed, one_in=3)
    assert _got(variants.variant_groups(words)) == _plain_variants(_plain_words(mixed, one_in=3))
    assert variants.variant_groups(variants.count_words(no_docs)).collect() == []


# --- shards


def _plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_equals_the_published_loop_and_moves_only_into_the_new_shard():
    rng = random.Random(3)
    keys = [0, 1, 2**60 - 1, *(rng.getrandbits(60) for _ in range(3000))]
    before = None
    for shards in (1, 2, 3, 8, 9, 10, 1000):
        got = sharding.jump(np.array(keys, np.uint64), shards).tolist()
        assert got == [_plain_jump(k, shards) for k in keys]
        if before is not None and shards in (9, 10):
            moved = [(a, b) for a, b in zip(before, got) if a != b]
            assert all(b == shards - 1 for _, b in moved) and 0.05 < len(moved) / len(keys) < 0.17
        before = got
    counts = Counter(sharding.jump(np.arange(40_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 8).tolist())
    assert max(counts.values()) < 1.1 * min(counts.values())
    with pytest.raises(ValueError):
        sharding.jump(np.array([1], np.uint64), 0)


def _plain_shards(rows, shards):
    placed = []
    for d, t in rows:
        key = int(hashlib.sha256(("" if d is None else str(d)).encode()).hexdigest()[:15], 16)
        raw = (t or "").encode()
        placed.append((d, len(raw) + 1, zlib.crc32(raw), "key", _plain_jump(key, shards), _plain_jump(key, shards + 1)))
    placed.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, out = Counter(), Counter()
    for d, size, crc, law, shard, grown in placed:
        out[(d, size, crc, law, shard, seen[shard], grown)] += 1
        seen[shard] += 1
    return out


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_and_slots_equal_plain_ones(spark, odd_docs, no_docs, shards):
    copies = odd_docs.unionByName(odd_docs.where("doc_id = 11").crossJoin(spark.range(500)).select(*odd_docs.columns))  # one row many times
    got = Counter(tuple(r) for r in sharding.shard_documents(copies, shards).collect())
    assert got == _plain_shards([(r["doc_id"], r["text"]) for r in copies.collect()], shards)
    assert sharding.shard_documents(no_docs, shards).collect() == []


def test_a_shard_is_appended_without_rewriting_the_others(spark, odd_docs, tmp_path):
    path = f"{tmp_path}/shards"
    docs = odd_docs.where("doc_id is not null").unionByName(spark.range(100, 400).selectExpr("id doc_id", "repeat('x', 5) text", "'en' lang", "'s' source", "5L n_chars", "'k' key", "'i' ids", "'s' score", "'p' spans", "'l' label", "'r' rank"))
    whole = Counter(tuple(r) for r in docs.collect())
    rows = lambda n: sharding.read_shards(spark, path, n)
    same = lambda n: Counter(tuple(r) for r in rows(n).select(*docs.columns).collect()) == whole
    sharding.write_shards(docs, path, 4)
    assert same(4)
    before = {r["doc_id"]: r["shard"] for r in rows(4).collect()}
    files = {f for f in tmp_path.rglob("*.parquet")}
    for n in (5, 6):
        sharding.append_shard(spark, path, n - 1)
        assert same(n)
        after = {r["doc_id"]: r["shard"] for r in rows(n).collect()}
        assert all(after[d] in (before[d], n - 1) for d in before) and n - 1 in after.values()
        before = after
    assert files <= set(tmp_path.rglob("*.parquet"))  # what was there stays as it is
    named, now, grown = sharding.assign_shards(odd_docs.withColumn("shard", F.lit("own")), 4)
    assert (now, grown) == ("shard_1", "grown_shard") and {r["shard"] for r in named.collect()} == {"own"}


# --- fill-in-middle


@settings(max_examples=100, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=1400))
def test_rank_and_select(bits):
    vector = fill_middle.BitVector(np.packbits(bits, bitorder="little"))
    places = np.flatnonzero(bits)
    assert vector.rank(np.arange(len(bits) + 1)).tolist() == [0, *np.cumsum(bits).tolist()]
    assert vector.select(np.arange(len(places))).tolist() == places.tolist()


def _plain_fim(doc_id, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def _check_fim(docs):
    found, name = fill_middle.fill_in_middle(docs)
    found = found.withColumn("back", fill_middle.restored(F.col(f"{name}.output"), F.col(f"{name}.form")))
    rows = found.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in docs.collect())
    for r in rows:
        got = r[name]
        assert (got["n"], got["form"], got["prefix_chars"], got["middle_chars"], got["output"]) == _plain_fim(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    return rows


def test_fill_in_middle_equals_a_plain_version(spark, odd_docs, no_docs):
    rng = random.Random(5)
    letters = ["a", "Zz", " ", "<", ">", "P", "S", "M", "\n", "\xe9", "中", "\U0001f600", "[", "@", "`", "{", "\x00", "<P", "S>", "word"]
    made = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(60)))) for i in range(400)]
    made += [(1000, "<P>"), (1001, "x<S>y"), (1002, "<M"), (None, "null id"), (1003, None), (1004, "y" * 100_000 + "\xe9" * 100_000), (1005, "ab" * 9)]
    rows = _check_fim(spark.createDataFrame(made, "doc_id long, text string"))
    assert {r["fim"]["form"] for r in rows} == {"plain", "psm", "spm"}
    _check_fim(odd_docs)
    assert _check_fim(no_docs) == []
    clash = spark.createDataFrame([(1, "some text", "a", "b")], "doc_id long, text string, fim string, fim_cuts string")
    assert fill_middle.fill_in_middle(clash)[1] == "fim_1" and fill_middle.fill_in_middle(clash)[0].first()["fim"] == "a"


def test_boundaries_over_several_pieces(monkeypatch):
    monkeypatch.setattr(fill_middle, "PIECE", 8)
    texts = ["", "abc defghij\xe9\xe9klm", "n", "", "opqrstuvwxyzabcdef", "\xe9"]
    h = np.arange(len(texts)) * 7 + 3
    for kind in (pa.string(), pa.large_string()):
        found = fill_middle.cuts(pa.array(["skip", *texts, None], kind)[1:], np.append(h, 1), np.append(h * 3, 1))
        for i, t in enumerate(texts):
            tokens = re.findall("[A-Za-z]+|[^A-Za-z]", t)
            a, b = sorted((h[i] % (len(tokens) + 1), h[i] * 3 % (len(tokens) + 1)))
            p, m = "".join(tokens[:a]), "".join(tokens[a:b])
            assert [int(found[c][i]) for c in found] == [len(tokens), len(p.encode()), len((p + m).encode()), len(p), len(m)]
        assert [int(v[-1]) for v in found.values()] == [0, 0, 0, 0, 0]
