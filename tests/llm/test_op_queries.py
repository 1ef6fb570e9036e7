"""The registered queries on the smallest tables, each against a plain version of its contract."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

from strandweave.llm import queries, toxicity
from strandweave.llm.decontaminate import normalize
from tests.llm.test_tables import _plain_links
from tests.llm.test_text_ops import _abuse, _plain_pii, _plain_secrets
from tests.llm.test_tokens import TIKTOKEN, WORDS


@pytest.fixture(scope="module")
def docs(spark, data):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, data, name):
    return queries.QUERIES[name](spark, data).collect()


def crc(value, n):
    return zlib.crc32(str(value).encode()) % n


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, data).toPandas()[list(want.columns)]
    plain = lambda df: Counter(tuple(None if pd.isna(x) else x for x in r) for r in df.itertuples(index=False))
    assert plain(got) == plain(want)


def test_op1_finds_every_item_that_stands_in_a_text(spark, data, docs):
    found = rows(spark, data, "op1_decontaminate")
    as_text = lambda t: normalize(t)[0].tobytes().decode("utf-32-le")
    items = {r["item_id"]: as_text(r["text"] or "") for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    texts = {d: as_text(t) for d, t in docs.items()}
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert {(d, i) for d, t in texts.items() for i, s in items.items() if s and s in t} <= got
    for r in found:  # what is found has the edits that it says
        size = r["item_end"] - r["item_start"]
        part, whole = as_text(docs[r["doc_id"]][r["doc_start"] : r["doc_end"]]), items[r["item_id"]][r["item_start"] : r["item_end"]]
        row = list(range(len(whole) + 1))
        for i, a in enumerate(part):
            new = [i + 1]
            for j, b in enumerate(whole):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (a != b)))
            row = new
        assert row[-1] <= r["edits"] <= max(4, 0.05 * size)


def test_op2_keeps_to_its_contract(spark, data, docs):
    found = rows(spark, data, "op2_toxicity")
    assert sorted(r["doc_id"] for r in found) == sorted(docs)
    for r in found:
        assert r["held_out"] == (crc(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    # scores are those of a plain walk over the words with the same model
    table = lambda t: spark.read.parquet(f"{data}/{t}.parquet")
    model = toxicity.ToxicityModel.fit(toxicity.ToxicityModel.training_rows(table("documents"), table("labels")))
    scorer = toxicity.Scorer(model.lexicon)
    for r in found:
        x = np.dot(scorer.features(docs[r["doc_id"]]), model.beta[:-1]) + model.beta[-1]
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-40, min(40, x))))) < 1e-6


def test_op3_equals_tiktoken(spark, data, docs):
    for r in rows(spark, data, "op3_byte_bpe"):
        text = docs[r["doc_id"]]
        ids = TIKTOKEN.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_op5_equals_the_library(spark, data, docs):
    library, start = Tokenizer.from_file(WORDS), 0
    found = sorted(rows(spark, data, "op5_token_records"), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in found] == sorted(docs)
    for r in found:
        ids = [*library.encode(docs[r["doc_id"]], add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_op6_counts_all_texts(spark, data, docs):
    words = {d: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), None] for d, t in docs.items()}
    counts = Counter(w for d, ws in words.items() if crc(d, 10) for w in ws)
    n, v = sum(counts.values()), len(counts)
    better = 0.0
    for r in rows(spark, data, "op6_lm_score"):
        own = words[r["doc_id"]]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(r["doc_id"], 10) == 0, len(own), sum(w in counts for w in own), n)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
        better += (r["score"] - base) * r["held_out"]
    assert better > 0


@pytest.mark.parametrize("name,plain,kinds", [("op7_pii", _plain_pii, ("email", "ip", "card", "phone")), ("op8_secret_scan", _plain_secrets, ("assign", "access", "hex"))])
def test_op7_and_op8_keep_the_fixed_spans(spark, data, docs, name, plain, kinds):
    found = rows(spark, data, name)
    assert sorted(r["doc_id"] for r in found) == sorted(docs)
    for r in found:
        base = plain(docs[r["doc_id"]])
        joined = [f"{k}:{a}:{b}" for k, a, b in base]
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in base) for k in kinds]
        assert r["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(joined) <= set(spans) and [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)


def test_op10_equals_all_pairs(spark, data, docs):
    got = Counter((r["doc_id"], r["class_id"], r["n_links"], r["n_text_links"]) for r in rows(spark, data, "op10_ngram_join"))
    assert got == _plain_links(list(docs.items()))


def test_op1_finds_edited_copies(spark, data, tmp_path):
    """At query level: items with an edit every 30 to 60 characters, set into other texts, are found; the other texts are not."""
    import random
    import shutil

    r = random.Random(8)
    shutil.copy(f"{data}/benchmark.parquet", tmp_path / "benchmark.parquet")
    items = [(x["item_id"], x["text"]) for x in spark.read.parquet(f"{data}/benchmark.parquet").collect() if len(x["text"] or "") >= 160]
    words = lambda n: " ".join("".join(r.choice("bcdfghjklmnp") for _ in range(r.randrange(3, 9))) for _ in range(n))
    rows, planted = [], set()
    for k, (item, text) in enumerate(items):
        out, at = list(text), r.randrange(20, 40)
        while at < len(out) - 10:
            out[at : at + r.choice((1, 1, 2))] = r.choice(("x", "", "qz"))
            at += r.randrange(34, 60)
        rows.append((k, f"{words(30)} {''.join(out)} {words(30)}", "en", "s", 0))
        planted.add((k, item))
    rows += [(1000 + k, words(200), "en", "s", 0) for k in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = {(x["doc_id"], x["item_id"]) for x in rows_of(spark, tmp_path)}
    assert len(planted & found) >= 0.95 * len(planted) and not any(d >= 1000 for d, _ in found)


def rows_of(spark, folder):
    return queries.QUERIES["op1_decontaminate"](spark, str(folder)).collect()


def _near(a, b):
    """At most one edit apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k:] == b[k:] or a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def _plain_toxicity(text, terms, innocent, known):
    """Features of a text by comparing each word with every term."""
    low = text.lower()
    found = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\W_]+", low)]
    words = [w for _, _, w in found]
    for w in set(words) - known.keys():
        whole = [k for k, (t, full, _) in enumerate(terms) if full and t == w]
        stems = sorted((k for k, (t, full, _) in enumerate(terms) if not full and w.startswith(t)), key=lambda k: len(terms[k][0]))
        close = []
        for k, (t, full, _) in enumerate(terms):
            reached = _near(w, t) and len(t) >= toxicity.FUZZY if full else len(t) > toxicity.FUZZY and any(_near(w[:n], t) for n in range(max(1, len(t) - 1), min(len(w), len(t) + 1) + 1))
            if reached and (w[0] == t[0] or len(t) >= toxicity.FIRST or w[0].isdigit()):
                close.append(k)
        if whole or stems:
            known[w] = (whole or stems[::-1])[0], False
        else:
            known[w] = (min(close, key=lambda k: (-terms[k][2], k)), True) if close and w not in innocent else None
    plain = [0.0] * 4
    address = strongest = count = 0
    for k, (a, b, w) in enumerate(found):
        if known[w] is None:
            continue
        term, fuzzy = known[w]
        weight, near = terms[term][2], set(words[max(0, k - 6) : k] + words[k + 1 : k + 7])
        left, right = low[max(0, a - 80) : a], low[b : b + 80]
        opened = max((left.rfind(c) for c in "\"“„«‘"), default=-1)
        quoted = opened >= 0 and any(not set(left[i + 1 :]) & set("\"”»’\n") for i, c in enumerate(left) if c in "\"“„«‘")
        closing = [i for i, c in enumerate(right) if c in "\"”»’“"]
        quoted = quoted and any(not set(right[:i]) & set("\"“„«‘\n") for i in closing)
        quoted = quoted or bool(near & toxicity.REPORT)
        plain[2 * fuzzy + quoted] += weight
        if not quoted:
            address, strongest, count = address + bool(near & toxicity.ADDRESS), max(strongest, weight), count + 1
    return [*(math.log1p(x) for x in plain), math.log1p(address), strongest, math.log1p(100 * count / max(1, len(words)))]


def test_op2_scores_equal_a_comparison_with_every_term(spark, data, docs):
    import random

    model = toxicity.ToxicityModel.fit(spark.createDataFrame(_abuse([("bligter", 2), ("swinelx", 100)], [("bligter", 11)]), "text string, toxic int"))
    known, hits, terms, r = {}, 0, model.lexicon.terms, random.Random(6)
    spelled = ["blighter", "bligter", "1lighter", "xblighter", "blighterz", "rotterhead", "rotterhaed", "swinelx", "swinely", "swine", "you", "said", "word", "plain", '"', "“", "”", "\n"]
    odd = {-1 - k: " ".join(r.choice(spelled) + r.choice(("", "", ",", '"')) for _ in range(r.randrange(1, 30))) for k in range(300)} | {-1000: ""}
    texts = {**docs, **odd}
    got = {r["doc_id"]: r["score"] for r in model.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for d, text in texts.items():
        x = _plain_toxicity(text, terms, model.lexicon.innocent, known)
        hits += any(x)
        z = sum(a * b for a, b in zip(x, model.beta)) + model.beta[-1]
        assert abs(got[d] - 1 / (1 + math.exp(-max(-40, min(40, z))))) < 1e-6, d
    assert hits > 200


def test_op6_scores_equal_dictionaries(spark, data, docs, monkeypatch):
    """Counts in dictionaries, mixed by the learned weights; these do better on their fold than equal ones."""
    from strandweave.llm import lm

    learned = []
    real = lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda *a: learned.append(real(*a)) or learned[-1])
    got = {r["doc_id"]: r["score"] for r in rows(spark, data, "op6_lm_score")}
    words = {d: ["<begin>", *re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), "<end> "] for d, t in docs.items()}

    def scores(of, training, weights):
        single, double = Counter(), Counter()
        for d in training:
            single.update(words[d][1:])
            single["<begin>"] += 1
            double.update(zip(words[d], words[d][1:]))
        n = sum(v for w, v in single.items() if w != "<begin>")
        out = {}
        for d in of:
            total = 0.0
            for a, b in zip(words[d], words[d][1:]):
                w = weights[min(lm.BUCKETS - 1, int(math.log2(single[a] + 1)))]
                total += math.log10(w[0] * double[a, b] / max(1, single[a]) + w[1] * single[b] / n + w[2] * uniform)
            out[d] = total
        return out

    training = [d for d in docs if crc(d, 10)]
    uniform = 1 / (len({w for d in training for w in words[d][1:]}) + 1)
    for d, want in scores(docs, training, learned[0]).items():
        assert abs(got[d] - want) < 1e-6 * max(1, abs(want)), d
    fold, rest = [d for d in training if crc(d, 10) == lm.FOLD], [d for d in training if crc(d, 10) != lm.FOLD]
    assert sum(scores(fold, rest, learned[0]).values()) > sum(scores(fold, rest, np.full((lm.BUCKETS, 3), 1 / 3)).values())
