"""Operators 4, 9 and 10 and the pipeline against brute force and odd rows."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandweave.llm import components, hamming, ngram_join, warc

# -- operator 4


def test_archives_read_back(spark):
    big = "<p>" + "x" * 1200
    rows = [(1, "http://a/1", big), (5, "http://a/5", big), (5, "http://a/5", big), (3, None, big), (None, "u", big), (7, "http://b b\n", "small"), (8, "u", "small"), (9, "u", None), (10, "u", ""), (11, "u", "é" * 700)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    path, index = warc.archive(df)
    got = Counter((r["key"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.read_archives(index, path).collect())
    want = Counter()
    for k, _, h in rows:
        raw = (h or "").encode()
        same = [i for i, _, g in rows if (g or "").encode() == raw and i is not None]
        revisit = len(raw) >= 1000 and k != max(same)
        want[(k, "revisit" if revisit else "response", max(same) if revisit else None, len(raw), hashlib.sha1(raw).hexdigest())] += 1
    assert got == want
    part = warc.read_archives(index.where("key in (5, 11)"), path).collect()
    assert sorted((r["key"], r["record_type"], bytes(r["payload"])) for r in part) == [(5, "response", big.encode())] * 2 + [(11, "response", ("é" * 700).encode())]
    path, index = warc.archive(df.where("false"))
    assert warc.read_archives(index, path).count() == 0


def test_records_parse_and_damage_is_seen():
    raw = warc.build_record(3, "http://x/y z", b"abc\r\n\r\n", hashlib.sha1(b"abc\r\n\r\n").hexdigest(), None)
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"\r\n\r\n") and b"y%20z" in raw
    assert warc.parse_record(raw)[5] == b"abc\r\n\r\n"
    with pytest.raises(ValueError):
        warc.parse_record(raw.replace(b"abc", b"abd"))


# -- operator 9


def _plain_top_k(rows, queries, k):
    dims = max(len(v) for _, v in rows + queries if v is not None)
    code = lambda v: np.array([x > 0 for x in v] + [False] * (dims - len(v)))
    out = Counter()
    for q, v in queries:
        if v is not None:
            near = sorted((int((code(v) != code(w)).sum()), i) for i, w in rows if w is not None and i is not None)[:k]
            out.update((q, r + 1, i, d) for r, (d, i) in enumerate(near))
    return out


@pytest.mark.parametrize("dims,n,k", [(64, 300, 10), (5, 40, 3), (100, 120, 7), (16, 4, 10)])
def test_top_k_is_exact(spark, dims, n, k, monkeypatch):
    r = np.random.default_rng(dims)
    centres = r.normal(size=(6, dims))
    rows = [(i, (centres[i % 6] + r.normal(size=dims) * (i % 4)).tolist()) for i in range(n)]
    rows += [(n + 1, rows[0][1]), (n + 2, rows[0][1]), (3, rows[3][1]), (None, rows[1][1]), (n + 5, None), (n + 6, rows[2][1][: dims // 2])]
    queries = rows[:: max(1, n // 12)] + rows[-2:]
    frame = lambda x: spark.createDataFrame([(*a, "c") for a in x], "vec_id long, embedding array<double>, code string")
    monkeypatch.setattr(hamming, "ENTRIES", 100)
    monkeypatch.setattr(hamming, "QUERIES", 5)
    monkeypatch.setattr(hamming, "LEAST", 20)
    got = Counter(tuple(x) for x in hamming.top_k(frame(rows), frame(queries), k).collect())
    assert got == _plain_top_k(rows, queries, k)
    assert hamming.top_k(frame(rows).where("false"), frame(queries), k).count() == 0


def test_blocks_give_every_core_work():
    assert hamming.blocks_of(50_000, 2_500, 12) == (1, 12)
    assert hamming.blocks_of(3_000, 300, 12) == (1, 3)
    e, q = hamming.blocks_of(10**8, 5 * 10**6, 2000)
    assert 10**8 / e <= hamming.ENTRIES and 5 * 10**6 / q <= hamming.QUERIES and q < 80
    assert hamming.blocks_of(0, 0, 8) == (1, 1)


# -- operator 10


def _plain_links(rows):
    def shingles(t):
        w = "".join(c if ord(c) >= 128 or c.isalnum() or c == "_" else " " for c in (t or "").lower()).split(" ")
        w = [x for x in w if x]
        n = min(5, len(w))
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset([("", t or "")])

    s = [shingles(t) for _, t in rows]
    linked = defaultdict(set)
    for i in range(len(rows)):
        for j in range(i):
            c = len(s[i] & s[j])
            if c >= 0.8 * (len(s[i]) + len(s[j]) - c) - 1e-9:
                linked[i].add(j)
                linked[j].add(i)
    label = list(range(len(rows)))
    for _ in rows:
        for i in linked:
            label[i] = min([label[i], *(label[j] for j in linked[i])])
    low = lambda ids: min((i for i in ids if i is not None), default=None)
    classes = {g: low(rows[i][0] for i in range(len(rows)) if label[i] == g) for g in set(label)}
    return Counter((rows[i][0], classes[label[i]] if classes[label[i]] is not None else rows[i][0], len(linked[i]), len({s[j] for j in linked[i]} - {s[i]})) for i in range(len(rows)))


def test_links_equal_all_pairs(spark, odd_docs, no_docs, monkeypatch):
    r = random.Random(6)
    rows = [(x["doc_id"], x["text"]) for x in odd_docs.collect()]
    for g in range(6):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice((8, 40, 120)))]
        for c in range(r.choice((2, 5, 30))):
            words = list(base)
            for _ in range(r.randrange(3)):
                words[r.randrange(len(words))] = f"n{r.randrange(50)}"
            rows.append((1000 + 100 * g + c, " ".join(words)))
    df = spark.createDataFrame([(*x, "k", "n") for x in rows], "doc_id long, text string, key string, label string").repartition(3)
    monkeypatch.setattr(ngram_join, "CELL", 8)
    monkeypatch.setattr(ngram_join, "GATHERED", 16)
    monkeypatch.setattr(ngram_join, "PAIRS", 2)
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    got = Counter((x["doc_id"], x["class_id"], x["n_links"], x["n_text_links"]) for x in ngram_join.near_duplicates(df).collect())
    assert got == _plain_links(rows)
    assert ngram_join.near_duplicates(no_docs).count() == 0


def test_one_large_group(spark):
    """600 near copies with the production constants, next to single documents."""
    r = random.Random(3)
    base = [f"w{r.randrange(900)}" for _ in range(150)]
    rows = [(5000 + k, " ".join(f"s{r.randrange(10**6)}" for _ in range(30))) for k in range(40)]
    for c in range(600):
        words = list(base)
        for _ in range(r.randrange(5)):
            words[r.randrange(len(words))] = f"n{r.randrange(10**6)}"
        rows.append((c, " ".join(words)))
    got = Counter((x["doc_id"], x["class_id"], x["n_links"], x["n_text_links"]) for x in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == _plain_links(rows)


def test_forest_spans_what_may_reach_the_threshold():
    r = np.random.default_rng(5)
    group = r.integers(0, 9, 70)
    centre = r.integers(0, 1 << 32, (9, 96), dtype=np.uint32)
    values = np.where(r.random((70, 96)) < 0.15, r.integers(0, 1 << 32, (70, 96), dtype=np.uint32), centre[group])
    words = np.frombuffer(b"".join(map(ngram_join.sketch_of, values)), np.uint64).reshape(-1, 4)
    n = np.full(70, 100)
    label = list(range(70))
    for _ in range(3):
        for x in range(70):
            for y in ngram_join._may_reach(n, words, x, np.arange(70), 0.8).tolist():
                label[x] = label[y] = min(label[x], label[y])
    edges = ngram_join.forest(n, words)
    assert len(edges) == 70 - len(set(label)) and all(label[a] == label[b] for a, b in edges)
    assert len(set(group.tolist())) == len(set(label))


def test_scratch_tables_go(spark):
    from pathlib import Path

    from strandweave.llm import common

    with common.scope(spark, "work"):
        one = common.materialize(spark.range(3).toDF("a"), "one")
        folder = Path(common.open_fs(one._written)[1])
        two = common.materialize(one, "two")
        common.discard(one)
        assert not folder.exists() and two.count() == 3
        assert "/work-" in str(folder)
    assert not folder.parent.exists()


def test_posterior_bound():
    assert ngram_join.least_matches(64, 8) < 0.8 * 64 and ngram_join.least_matches(64, 8) > 0.3 * 64
    assert ngram_join.least_matches(32, 8, tolerance=0.5) > ngram_join.least_matches(32, 8)


def test_lower_thresholds_are_refused(odd_docs):
    with pytest.raises(ValueError, match="threshold"):
        ngram_join.near_duplicates(odd_docs, threshold=0.7)


def test_components(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(40) if i % 11] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)] + [(200, 200), (201, None)]
    got = {x["node"]: x["label"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges for n in e if n is not None}
    for _ in label:
        for a, b in edges:
            if b is not None:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- pipeline


def test_pipeline_stages(spark, data):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = docs
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, seen, data)
        assert out.columns == docs.columns, name
        out = cp.materialize(out, f"test-{name}")
        assert 0 < out.count() <= seen.count(), name
        seen = out
    last = cp.STAGES[-1][1](spark, seen, data)
    rows = {x["doc_id"]: x for x in last.collect()}
    for x in seen.collect():
        assert rows[x["doc_id"]]["decoded_sha256"] == hashlib.sha256((x["text"] or "").encode()).hexdigest()
        assert x["n_chars"] == len(x["text"])
    classes = ngram_join.near_duplicates(seen)
    assert classes.where("n_links > 0").count() == 0


def test_pipeline_on_odd_rows(spark, odd_docs, no_docs, data):
    import corpus_pipeline as cp

    for docs in (odd_docs, no_docs):
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, data)
            assert out.columns == docs.columns and out.count() <= docs.count()
    several = spark.createDataFrame([(1, "one two three"), (2, "one two three"), (2, "a text of its own"), (3, "x y"), (3, "x y"), (None, "x y")], "doc_id long, text string")
    kept = cp.drop_near_duplicates(spark, several, data)
    assert sorted((x["doc_id"] or 0, x["text"]) for x in kept.collect()) == [(0, "x y"), (1, "one two three"), (2, "a text of its own"), (3, "x y")]
    kept = cp.drop_near_duplicates(spark, odd_docs, data)
    assert sorted(x["doc_id"] for x in kept.where("doc_id is not null").collect()) == [1, 4, 6, 7, 8, 9, 10, 11, 13]
