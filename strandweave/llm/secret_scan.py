"""Operator 8: secrets tagged by a linear-chain conditional random field.

Tokens (runs of ASCII letters and digits, single other signs) are tagged as begin or inside of a
secret or outside of one, from their shape, the neighbouring tokens and features of the file,
and decoded by Viterbi. The field is trained here: on windows of a bounded sample of documents
that fixed patterns mark, on the same windows with made-up secrets of other formats put in, and
on windows without secrets. Fixed patterns (assign, access, hex) always stay; the field adds
spans of kind ``crf`` that overlap none of them.

Decoding is exact: tokens that lie in no stretch whose leads over outside and transitions could
outweigh its ends are outside in the best path, so only the others go through Viterbi. A span of signs alone is dropped.

Defined results: null and empty texts have no spans. A secret may begin with any token. Texts of
any length are scanned whole, in time proportional to it. Of paths of equal worth the one that is
outside, or begins, at the last token where they differ is taken. Repeated rows give repeated
results; other columns pass through, a ``base`` or ``spans`` column among them (the new ones then
take the next free name). Without training documents the made-up windows alone train the field.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memory, tidied
from .spans import FOUND, found_array, free_of, in_order, mask, with_found

KINDS = ("assign", "access", "hex", "crf")
# Fixed patterns.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Documents whose windows the field is trained on: about a third of so many, and of those with a word
#: of the fixed patterns eight times that share. At most three times so many windows count, and of a
#: text at most three: around its first two fixed matches, and one more.
SAMPLE = 1500
#: Characters of a training window, at most.
WINDOW = 600
#: Tokens of a training window, at most.
LONGEST = 64
#: Tokens of fewer letters count as short.
LEAST = 6
REMEMBERED = 300_000
SIGN = "<SECRET>"

TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
DIGIT = re.compile("[0-9]")
HAS_DIGIT = re.compile("[0-9]").search
SIGNS = "\"'=:;,.+/_-@#$%&!?(){}[]<>|"
HEXES = re.compile("[0-9a-fA-F]+").fullmatch
CUES = {*"password passwd passphrase pwd secret token key apikey api auth authorization bearer credential credentials private access client signature".split()}
PREFIXES = ("AKIA", "ASIA", "ghp", "gho", "glpat", "sk", "pk", "xoxb", "xoxp", "eyJ", "AIza", "npm", "hf")
OFFSETS = (-4, -3, -2, -1, 1)


#: v * log2(v) of small counts.
LOGS = [0.0, *(v * math.log2(v) for v in range(1, 64))]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each fixed pattern that pass its check."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return in_order(out, KINDS)


def shape(token: str) -> tuple:
    """What the features of a token depend on; few shapes stand for many tokens."""
    n = len(token)
    if n == 1 and not token.isalnum():
        return (token if token in SIGNS else "*",)
    size = min(n.bit_length(), 7)
    distinct = set(token)
    entropy = math.log2(n)
    if len(distinct) < n:
        entropy -= sum([LOGS[v] if v < len(LOGS) else v * math.log2(v) for v in map(token.count, distinct)]) / n
    word = token.isalpha()
    if word and token.islower():
        kind, turns, capital = "l", 0, False
    elif word and token[1:].islower() and n > 1:
        kind, turns, capital = "Ul", 1, True
    else:
        digits, upper = sum(map(str.isdigit, token)), sum(map(str.isupper, token))
        kind = "d" * (digits > 0) + "U" * (upper > 0) + "l" * (n > digits + upper)
        turns = sum(map(int.__ne__, map(_kind, token), map(_kind, token[1:])))
        capital = upper == 1 and token[0].isupper() and not digits
    hexes = n >= 16 and kind in ("dl", "dU", "d") and HEXES(token) is not None
    if kind[0] == "d" or kind == "U":
        prefix = next(filter(token.startswith, PREFIXES), "")
    else:
        prefix = token if token in PREFIXES else ""
    return kind, size, min(turns, 8), int(entropy * 2), int(6 * turns / n), capital, hexes, token.lower() in CUES, prefix, n < LEAST


@lru_cache(maxsize=100_000)
def shape_features(s: tuple) -> tuple[str, ...]:
    if len(s) == 1:
        return "sign", f"sign={s[0]}"
    kind, size, turns, entropy, share, capital, hexes, cue, prefix, short = s
    out = [
        f"kind={kind}", f"length={size}", f"kind={kind},length={size}", f"turns={turns}", f"entropy={entropy}",
        f"kind={kind},entropy={entropy // 2}", f"turn share={share}",
    ]
    out += ["capital"] * capital + ["hex"] * hexes + ["cue"] * cue + [f"prefix={prefix}"] * bool(prefix) + ["short"] * short
    return tuple(out)


def own_features(token: str) -> list[str]:
    """Shape of one token."""
    return list(shape_features(shape(token)))


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2


#: Signs that a neighbour tells one by one; the others count alike.
SIDE_SIGNS = "=:\"'+/_.-@"


def side_kind(token: str) -> str:
    """What kind of neighbour a token is."""
    if token.lower() in CUES:
        return "cue"
    if len(token) == 1 and not token.isalnum():
        return f"sign={token if token in SIDE_SIGNS else '*'}"
    return "digits" if token.isdigit() else "mixed" if HAS_DIGIT(token) else "word"


def side_features(token: str, offset: int) -> list[str]:
    """What a token tells about one ``offset`` away."""
    return [f"{offset}:{side_kind(token)}"]


def file_features(text: str) -> list[str]:
    n = max(1, len(text))
    digits = len(DIGIT.findall(text))
    return [f"file:digits={min(4, int(20 * digits / n))}", f"file:signs={min(4, int(40 * sum(map(text.count, '={}:;')) / n))}"]


class Field:
    """Weights of a trained field. Tags: 0 outside, 1 begin, 2 inside."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves
        #: The most that a transition inside a secret can win over one between outside tokens, and what
        #: its first and last transitions together can.
        self.inner = float(moves[1:, 1:].max() - moves[0, 0])
        self.ends = float(moves[0, 1] + moves[1:, 0].max() - 2 * moves[0, 0])
        self.first, self.last = self.score(["first"]), self.score(["last"])
        #: Row of ``table`` of a token; tokens of one shape and kind share a row.
        self.types = Memory(self._type, REMEMBERED)
        self.rows: dict[tuple, int] = {}
        self.table = np.empty((1024, 3 + 3 * len(OFFSETS)))

    def score(self, features: list[str]) -> np.ndarray:
        rows = [self.names[f] for f in features if f in self.names]
        return self.weights[rows].sum(axis=0) if rows else np.zeros(3)

    def _type(self, token: str) -> int:
        """Row of ``table`` for a token: its own scores and what it gives its neighbours."""
        key = (shape(token), side_kind(token))
        row = self.rows.get(key)
        if row is None:
            row = self.rows[key] = len(self.rows)
            if row == len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            own = self.score(list(shape_features(key[0])))
            self.table[row] = np.concatenate([own] + [self.score([f"{o}:{key[1]}"]) for o in OFFSETS])
        return row

    def emissions(self, tokens: list[str], file: np.ndarray) -> np.ndarray:
        rows = np.fromiter(map(self.types.__getitem__, tokens), np.int64, len(tokens))
        self.types.trim()
        table = self.table[rows]
        e = table[:, :3] + file
        for j, o in enumerate(OFFSETS):
            part = table[:, 3 * j + 3 : 3 * j + 6]
            if o < 0:
                e[-o:] += part[:o]
            else:
                e[:-o] += part[o:]
        e[0] += self.first
        e[-1] += self.last
        return e

    def spans(self, text: str) -> list[tuple[int, int]]:
        tokens = TOKEN.findall(text)
        if not tokens:
            return []
        e = self.emissions(tokens, self.score(file_features(text)))
        hot = np.flatnonzero(self.open_tokens(e))
        if not len(hot):
            return []
        found = list(TOKEN.finditer(text))
        out = []
        for part in np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1):
            if not len(part):
                continue
            tags = self.viterbi(e[part[0] : part[-1] + 1])
            k = 0
            while k < len(tags):
                if tags[k]:
                    last = k
                    while last + 1 < len(tags) and tags[last + 1] == 2:
                        last += 1
                    out.append((found[part[0] + k].start(), found[part[0] + last].end()))
                    k = last
                k += 1
        return out

    def open_tokens(self, e: np.ndarray) -> np.ndarray:
        """Tokens that lie in some stretch which could be worth more as a secret than outside.

        A secret of k tokens wins their leads over outside, at most ``inner`` for each of its k - 1 own
        transitions and at most ``ends`` for the two at its ends; the best path holds none that loses.
        """
        u = np.maximum(e[:, 1], e[:, 2]) - e[:, 0] + self.inner
        sums = np.concatenate(([0.0], np.cumsum(u)))
        left = sums[:-1] - np.minimum.accumulate(sums[:-1])  # best stretch that ends before each token
        right = (np.maximum.accumulate(sums[::-1])[::-1] - sums)[1:]  # best that starts after it
        return u + left + right + self.ends - self.inner > -1e-9

    def viterbi(self, e: np.ndarray) -> list[int]:
        """Best tags of a stretch between outside tokens."""
        score = e[0] + self.moves[0]
        back = []
        for row in e[1:]:
            paths = score[:, None] + self.moves
            back.append(paths.argmax(axis=0))
            score = paths.max(axis=0) + row
        tags = [int((score + self.moves[:, 0]).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]


MADE_KEYS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "auth", "Authorization: Bearer", "client_secret", "private_key", "access key", "credential")


def made_secret(r: random.Random) -> str:
    letters = "abcdefghijklmnopqrstuvwxyz"
    full = letters + letters.upper() + "0123456789"
    pick = lambda s, n: "".join(r.choice(s) for _ in range(n))
    kind = r.choice((0, 1, 2, 2, 3, 4, 5, 6, 7, 7, 8))
    if kind == 0:
        return pick("0123456789abcdef", r.choice((32, 40, 64)))
    if kind == 1:
        return r.choice(("AKIA", "ASIA")) + pick(letters.upper() + "0123456789", 16)
    if kind == 2:
        if r.random() < 0.2:  # numbers in groups before the letters
            return f"xox{r.choice('abp')}-{pick('0123456789', r.randrange(9, 14))}-" + (pick("0123456789", 12) + "-") * r.randrange(2) + pick(full, 24)
        return r.choice(("ghp_", "glpat-", "sk-", "xoxb-", "npm_", "hf_")) + pick(full, r.randrange(24, 40))
    if kind == 3:
        return "eyJ" + pick(full, 20) + "." + pick(full, 30) + "." + pick(full, 24)
    if kind == 4:
        return pick(full + "+/", r.randrange(24, 60)) + "=" * r.randrange(3)
    if kind == 5:
        return "-".join(pick(full, r.randrange(5, 9)) for _ in range(r.randrange(2, 5)))
    if kind == 6:  # groups of one short length
        n = r.randrange(3, 6)
        return r.choice("---.:_").join(pick(full, n) for _ in range(r.randrange(3, 7)))
    if kind == 7:  # a password with signs in it, by chance or for letters of words
        if r.random() < 0.3:  # words with digits for letters, joined by signs
            spelled = lambda: "".join({"e": "3", "o": "0", "i": "1", "a": "4", "s": "5"}.get(c, c) if r.random() < 0.6 else c for c in pick("aeiou", 1) + pick("rnlst", 1) + pick("aeiou", 1) + pick(letters, r.randrange(1, 4))).capitalize()
            return spelled() + r.choice("!@#$%&*") + r.choice((spelled(), pick(letters, r.randrange(3, 6)).capitalize())) + r.choice(("", r.choice("!@#$%&*"))) + pick("0123456789", r.randrange(1, 5))
        part = (lambda n: pick(full, n)) if r.random() < 0.5 else lambda n: r.choice((pick(letters, n), pick(letters, n).capitalize(), pick(letters, n) + pick("0134579", 1) + pick(letters, 2)))
        return part(r.randrange(1, 4)) + "".join(r.choice("@!#$%&*?^~+") + part(r.randrange(1, 6)) for _ in range(r.randrange(2, 5)))
    return pick(full, r.randrange(10, 30))


def made_decoy(r: random.Random) -> str:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    h = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    uuid = f"{h(8)}-{h(4)}-4{h(3)}-{r.choice('89ab')}{h(3)}-{h(12)}"
    upper = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
    tool = r.choice(("x86_64", "aarch64", "amd64", "i686", "sha256sum", "md5sum", "utf-8", "iso-8859-1", f"python3.{d(1)}", f"libssl{d(1)}.{d(1)}", f"lib{h(3)}{d(1)}-dev", f"gcc-{d(2)}", f"base{d(2)}", f"win{d(2)}", f"ipv{d(1)}", f"node{d(2)}.x", f"h{d(3)}p"))
    return r.choice(
        (
            uuid, f"id {uuid}", f"request-id: {uuid}", f"{{{uuid.upper()}}}", f"urn:uuid:{uuid}", f"-----BEGIN {upper(r.randrange(4, 9))}-----", f"-----END {upper(r.randrange(4, 9))} {upper(3)}-----", "-" * r.randrange(3, 30), "=" * r.randrange(3, 20),
            f"built for {tool} on linux", f"{tool} and {r.choice(('x86_64', 'arm64', 'utf-8'))}", f"apt install {tool}", f"{tool}_{d(1)}", f"commit {h(7)}", f"#{h(6)}", f"color: #{h(6)};", f"/usr/lib/{tool}/bin", f"{upper(2)}-{d(4)}-{d(4)}", f"ISBN {d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}",
            d(16), f"+1 ({d(3)}) 555-{d(4)}", f"{d(3)}.{d(2)}.{d(3)}.{d(2)}", f"user.{d(2)}@mail{d(1)}.example.com", f"20{d(2)}-0{r.randrange(1, 10)}-1{d(1)}",
            f"https://www.example.com/page{d(3)}", "Internationalisation", "HTTPServer2", d(7), "the token was given", "a secret garden of words", "password reset page",
            ".".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(r.randrange(2, 5))) + ".", f"20{d(2)}-{d(2)}-{d(2)} {d(2)}:{d(2)}:{d(2)}", f"v{d(1)}.{d(2)}.{d(1)}-rc{d(1)}",
            "\"No!\" (and then?) left; B2B", "state-of-the-art e-mail", f"{d(1)}+{d(1)}={d(2)} & {d(2)}%", f"R&D, Q{d(1)}-20{d(2)}", "key=value; api: see docs/auth.md",
            f"x = y + {d(1)}*z; if (a < b) {{ return c; }}", "for (int i = 0; i < n; i++) { sum += a[i]; }", "def f(a, b=None): return a[b:] + g(a)", '<a href="#top">Top</a>', "SELECT a, b FROM t WHERE c = 'x';",
            f"Flights {r.choice('ABLQ')}{r.choice('AHUF')}{d(4)} and BA{d(4)} at {d(2)}:{d(2)} from gate B{d(2)}.", f"See section {d(1)}.{d(1)} of RFC-{d(4)}, page {d(2)}.",
            f"Dr. Hall's office (Room {d(1)}{r.choice('ABC')}) opens {d(1)}:00-{d(2)}:30, Mon.-Fri.", f"The EU's A/{d(2)}/{d(1)}; cf. C-{d(3)}/{d(2)}, para. {d(1)}.", f"CPU: {d(1)}x B{d(3)}-{d(2)}GB, {d(1)}TB disk; {d(2)}.{d(2)}/h",
            f"| a | b{d(1)} | {d(2)} |", "*** !!! --- ###", f"a[{d(1)}] = {{'k': \"v\", 'n': {d(2)}}}", "(see: www.example.org/a/b?c=d&e=f)",
        )
    )


def training_windows(found: list[tuple[str, list[tuple]]], seed: int = 7) -> list[tuple[str, list[tuple[int, int]]]]:
    """(text, secret spans): the windows as they are, and with made-up secrets and decoys put in."""
    r = random.Random(seed)
    out = []
    plain = [t for t, s in found if not s] or ["some words of a text and then some more of them here"]
    for text, spans in found:
        out.append((text, [(a, b) for _, a, b in spans]))
    for k in range(max(600, min(SAMPLE, len(found)))):
        text = r.choice(plain)
        words = text.split(" ")
        at = r.randrange(len(words) + 1)
        left, right = " ".join(words[:at]), " ".join(words[at:])
        if k % 5 == 0:  # little else in the text
            left, right = " ".join(words[max(0, at - 4) : at]), " ".join(words[at : at + 4])
        if k % 3 == 2:
            out.append((f"{left} {made_decoy(r)} {r.choice((right, made_decoy(r)))}", []))
            continue
        secret = made_secret(r)
        quote = r.choice(("", "", '"', "'"))
        lead = f"{left} " + (r.choice(MADE_KEYS) + r.choice((" = ", "=", ": ", ":", " ")) if k % 3 == 0 else "") + quote
        if len(secret) < 20 and k % 3:  # a short string without a cue is no secret
            out.append((f"{lead}{secret[:9]}{quote} {right}", []) if secret[:9].isalpha() else (f"{left} {right}", []))
        else:
            out.append((f"{lead}{secret}{quote} {right}", [(len(lead), len(lead) + len(secret))]))
    return out


def train(windows: list[tuple[str, list[tuple[int, int]]]], rounds: int = 50, rate: float = 0.5, ridge: float = 2e-3) -> Field:
    """Weights of greatest likelihood (with an L2 penalty) by AdaGrad over all windows at once."""
    names: dict[str, int] = {}
    rows, tags = [], []
    for text, spans in windows:
        found = list(TOKEN.finditer(text))[:LONGEST]
        if not found:
            continue
        toks = [m[0] for m in found]
        file = file_features(text)
        row = []
        for k, t in enumerate(toks):
            f = own_features(t) + file
            for o in OFFSETS:
                if 0 <= k + o < len(toks):
                    f = f + side_features(toks[k + o], o)
            f += ["first"] * (k == 0) + ["last"] * (k == len(toks) - 1)
            row.append([names.setdefault(x, len(names)) for x in f])
        tag = []
        for m in found:
            hit = next((s for s in spans if s[0] <= m.start() and m.end() <= s[1]), None)
            tag.append(0 if hit is None else 1 if not tag or tag[-1] == 0 or not any(s is hit and s[0] <= found[len(tag) - 1].start() for s in spans) else 2)
        rows.append(row)
        tags.append(tag)
    n, length = len(rows), max(map(len, rows))
    width = max(len(f) for r in rows for f in r)
    pad = len(names)
    x = np.full((n, length, width), pad, np.int32)
    y, live = np.zeros((n, length), np.int64), np.zeros((n, length), bool)
    for i, (row, tag) in enumerate(zip(rows, tags)):
        y[i, : len(tag)], live[i, : len(tag)] = tag, True
        for k, f in enumerate(row):
            x[i, k, : len(f)] = f
    w, move = np.zeros((pad + 1, 3)), np.zeros((3, 3))
    barred = np.zeros((3, 3))
    barred[0, 2] = -1e9  # inside never follows outside
    begin = np.array([0.0, 0.0, -1e9])
    gw, gm = np.full_like(w, 1e-8), np.full_like(move, 1e-8)
    onehot = np.eye(3)[y] * live[..., None]
    true_moves = np.einsum("nti,ntj->ij", onehot[:, :-1], onehot[:, 1:])
    flat = x.reshape(-1)
    for _ in range(rounds):
        e = w[x].sum(axis=2)
        m = move + barred
        a = np.empty((n, length, 3))
        a[:, 0] = e[:, 0] + begin
        for t in range(1, length):
            s = a[:, t - 1, :, None] + m
            top = s.max(axis=1)
            a[:, t] = np.where(live[:, t, None], top + np.log(np.exp(s - top[:, None]).sum(axis=1)) + e[:, t], a[:, t - 1])
        b = np.zeros((n, length, 3))
        pair = np.zeros((3, 3))
        top = a[:, -1].max(axis=1)
        z = top + np.log(np.exp(a[:, -1] - top[:, None]).sum(axis=1))
        for t in range(length - 2, -1, -1):
            s = m + (e[:, t + 1] + b[:, t + 1])[:, None, :]
            both = a[:, t, :, None] + s - z[:, None, None]
            pair += (np.exp(both) * live[:, t + 1, None, None]).sum(axis=0)
            top = s.max(axis=2)
            b[:, t] = np.where(live[:, t + 1, None], top + np.log(np.exp(s - top[..., None]).sum(axis=2)), 0)
        p = np.exp(a + b - z[:, None, None]) * live[..., None]
        diff = ((onehot - p) / n).reshape(-1, 3)
        grad = np.stack([np.bincount(flat, np.repeat(diff[:, c], width), pad + 1) for c in range(3)], axis=1) - ridge / 10 * w
        gmove = (true_moves - pair) / n - ridge / 10 * move
        gw += grad**2
        gm += gmove**2
        w += rate * grad / np.sqrt(gw)
        w[pad] = 0
        move += rate * gmove / np.sqrt(gm)
    return Field(names, w[:pad], move + barred)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most three windows of a text: around fixed matches, and one without."""
    for batch in batches:
        texts, spans = [], []
        for t in batch.column(0):
            text = t.as_py() or ""
            base = base_spans(text)
            places = [(a + b) // 2 for _, a, b in base[:2]] + [(len(text) * 7919) % max(1, len(text) + 1) // 2]
            for p in places:
                a = max(0, text.rfind(" ", 0, max(0, p - 90)) + 1)
                b = text.find(" ", p + 90)
                b = len(text) if b < 0 else min(b, p + 400)
                texts.append(text[a : max(a, b)][:WINDOW])
                spans.append([s[1] - a for s in base if a <= s[1] and s[2] <= a + WINDOW] + [s[2] - a for s in base if a <= s[1] and s[2] <= a + WINDOW])
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.int64()))], names=["text", "marks"])


def secret_value(text: str, span: tuple[int, int]) -> tuple[int, int]:
    """The secret inside a fixed match: of an assignment its value."""
    m = ASSIGN.match(text, *span)
    return m.span(2) if m else span


def fit(docs: DataFrame, text: str = "text") -> Field:
    """A field trained on windows of about ``SAMPLE`` / 3 documents, picked by a hash of the text."""
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text")).where("text is not null")
    count = rows.count()
    share = min(1.0, SAMPLE / 3 / max(1, count))
    cued = F.lower("text").rlike("password|passwd|secret|token|api_?key|akia")
    hashed = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    picked = rows.where(hashed < int(share * (1 << 40)) + 1)
    more = rows.where((hashed >= int(share * (1 << 40)) + 1) & (hashed < int(min(1.0, 8 * share) * (1 << 40))) & cued)
    got = picked.unionByName(more).mapInArrow(_windows, "text string, marks array<long>").collect()
    found = []
    rows = {(r["text"], tuple(r["marks"])) for r in got}
    for r in sorted(rows, key=lambda r: (zlib.crc32(r[0].encode("utf-8", "surrogatepass")), r))[: 3 * SAMPLE]:
        n = len(r[1]) // 2
        spans = {secret_value(r[0], s) for s in zip(r[1][:n], r[1][n:])}
        found.append((r[0], [("", a, b) for a, b in spans]))
    return train(training_windows(found))


def finder(field: Field):
    """A column function text -> struct(base, spans)."""

    @F.arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        base, spans = [], []
        for t in texts:
            b, s = scan(field, t.as_py() or "")
            base.append(b)
            spans.append(s)
        return tidied(found_array(base, spans))

    return find


def scan(field: Field, text: str) -> tuple[list[tuple], list[tuple]]:
    """(fixed spans, all spans) of one text."""
    base = base_spans(text)
    added = [("crf", a, b) for a, b in field.spans(text) if any(map(str.isalnum, text[a:b]))]  # signs alone are no secret
    added = [s for s, free in zip(added, free_of(added, base)) if free]
    return base, in_order(base + added, KINDS) if added else base


def scan_documents(df: DataFrame, text: str = "text", field: Field | None = None) -> DataFrame:
    """``df`` with ``base`` and ``spans``, arrays of (kind, start, end)."""
    return with_found(df, finder(field or fit(df, text))(F.col(f"`{text}`")))


def redact(df: DataFrame, text: str = "text", field: Field | None = None, sign: str = SIGN) -> DataFrame:
    """``df`` with every span of ``text`` replaced; a null text stays null."""
    chosen = field or fit(df, text)

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        return tidied(pa.array([None if (s := t.as_py()) is None else mask(s, scan(chosen, s)[1], sign) for t in texts], pa.string()))

    return df.withColumn(text, masked(F.col(f"`{text}`")))
