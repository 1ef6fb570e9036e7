"""Operator 7: personal data by candidate generation and gradient-boosted trees.

Generators propose overlapping spans with high recall (anything like an address, a dotted
quad, a long number, a spelled-out address). Boosted trees score each candidate from its format
and its context; the calibrated probability must reach its kind's threshold, which is the least
one that keeps the wanted precision on held-out candidates. Spans of the fixed patterns (email,
ip, card, phone) always stay; a selected candidate is added where it overlaps none of them and no
better candidate.

The trees are trained here, on candidates from a bounded sample of documents that the fixed
patterns mark, and on made-up contexts with data in other spellings and with look-alikes. They are
calibrated, and thresholds set, on all documents of the third (by the text's CRC-32) that the trees never
see: their own fixed-format data, spelled anew by rules that the training does not use, where it stands,
against every other candidate there (and a few standing lines, so that every kind occurs). The tasks count
these by kind and margin, so their number doesn't matter.

Defined results: null and empty texts have no spans; repeated rows give repeated results; texts of
any length are read whole. Of overlapping candidates of equal probability the one that starts first
is taken, then the kind that comes first in the alphabet. Other columns pass through, a ``base`` or
``spans`` column among them (the new ones then take the next free name). Without documents the
made-up contexts alone train.
"""

from __future__ import annotations

import bisect
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .spans import FOUND, found_array, free_of, in_order, mask, with_found

KINDS = ("email", "ip", "card", "phone")
#: Documents whose candidates the trees are trained on, at most about so many; of each, windows of at
#: most so many characters around so many candidates, those of the least hashes.
SAMPLE, WINDOW, WINDOWS = 2000, 600, 3
#: Precision that a kind's threshold keeps on held-out candidates.
PRECISION = 0.97
#: Held-out texts (one in three), steps of a margin in which candidates are counted, and characters around data that is spelled anew.
HELD, STEPS, AROUND = 3, 64, 300
CONTEXT = 48
SIGN = "<PII>"

# Fixed patterns; possessive where a retry could not match either, so that long runs take linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
QUAD = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Generators.
SPELLED = re.compile(r"(?:[\w+-]+ (?:dot|DOT) ){0,3}[\w.+-]+ ?[\[(<{]? ?(?:at|AT|@) ?[\])>}]? ?[\w-]+(?: ?[\[(<{]? ?(?:dot|DOT|\.) ?[\])>}]? ?[\w-]+)+")
NUMBER = re.compile(r"(?<![0-9])[(+]?[0-9](?:[ ().\-/]{0,2}[0-9]){6,18}(?![0-9])")
SPREAD = re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?[\[(]?(?:\.|dot)[\])]? ?[0-9]{1,3}){3}(?![0-9])")
CUES = {
    "email": re.compile(r"mail|contact|write|reach|address|correo|adresse|courriel", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|login|client|addr", re.I),
    "card": re.compile(r"card|visa|master|credit|debit|payment|account|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|call|tel|mobile|cell|fax|dial|ring|number|telefon|téléphone|teléfono", re.I),
}
FEATURES = 24


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each sign's local part is the whole run before it, not reaching into the last match."""
    last, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            yield a, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each fixed pattern that pass its check."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in QUAD.finditer(text) if all(map(_octet, m.groups()))]
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return in_order(out, KINDS)


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping proposals (kind, start, end)."""
    out = []
    if "@" in text or "dot" in text or "DOT" in text:
        out += [("email", m.start(), m.end()) for m in SPELLED.finditer(text) if "@" in m[0] or "dot" in m[0].lower()]
    for m in NUMBER.finditer(text):
        n = sum(c.isdigit() for c in m[0])
        if n >= 13:
            out.append(("card", m.start(), m.end()))
        if 7 <= n <= 15:
            out.append(("phone", m.start(), m.end()))
    out += [("ip", m.start(), m.end()) for m in SPREAD.finditer(text)]
    return out


def features(text: str, span: tuple[str, int, int]) -> list[float]:
    """Format and context of one candidate."""
    kind, a, b = span
    s = text[a:b]
    left, right = text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    digits = [c for c in s if "0" <= c <= "9"]
    groups = re.findall(r"[0-9]+", s)
    signs = sum(not c.isalnum() and c != " " for c in s)
    return [
        KINDS.index(kind), len(s), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        signs, s.count(" "), s.count("."), s.count("-"), s.count("("), s.startswith("+"), "@" in s,
        luhn("".join(digits)) if digits else 0, all(map(_octet, groups)) if groups else 0,
        bool(re.search(r"(?:dot|\.) ?[\])>}]? ?(?:com|org|net|edu|io|de|fr|es|uk)$", s, re.I)), sum(c.isalpha() for c in s),
        bool(CUES[kind].search(left[-32:])), bool(CUES[kind].search(right[:24])), any(CUES[k].search(left[-24:]) is not None for k in KINDS if k != kind),
        left[-1:].isalnum(), right[:1].isalnum(), left.rstrip()[-1:] in {":", "="}, sum(c.isdigit() for c in left + right),
    ]


class PiiModel:
    def __init__(self, trees: BoostedTrees, thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def scan_all(self, texts: list[str]) -> tuple[list[list[tuple]], list[list[tuple]]]:
        """(fixed spans, all spans) of each text; the trees see all candidates at once."""
        base = [base_spans(t) for t in texts]
        pool, rows = [], []
        for k, (t, own) in enumerate(zip(texts, base)):
            proposed = candidates(t)
            for c, free in zip(proposed, free_of(proposed, own)):
                if free:
                    pool.append((k, c))
                    rows.append(features(t, c))
        spans = [list(s) for s in base]
        if rows:
            p = self.trees.predict(np.array(rows, float))
            added: dict[int, list[tuple[int, int]]] = {}  # of each text: sorted, none overlaps another
            for i in sorted(range(len(pool)), key=lambda i: (-p[i], pool[i][0], pool[i][1][1], pool[i][1][0], pool[i][1][2])):
                k, c = pool[i]
                if p[i] < self.thresholds[c[0]]:
                    continue
                own = added.setdefault(k, [])
                at = bisect.bisect_left(own, (c[1], c[2]))
                if (not at or own[at - 1][1] <= c[1]) and (at == len(own) or c[2] <= own[at][0]):
                    own.insert(at, (c[1], c[2]))
                    spans[k].append(c)
        return base, [in_order(s, KINDS) for s in spans]


def made_rows(texts: list[str], seed: int = 11, count: int = 3000) -> tuple[list[list[float]], list[int]]:
    """Candidates in contexts of the sample: data in other spellings (1) and look-alikes (0)."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(3, 9)))
    octet = lambda: str(r.randrange(256))

    def card() -> str:
        body = d(15)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def positive() -> tuple[str, str, str]:
        k = r.randrange(9)
        if k == 0:
            local = r.choice((f"{word()}.{word()}", f"{word()} dot {word()}", word(), f"{word()}_{d(2)}"))
            return "email", r.choice(("mail me: ", "contact ", "", "write to ")), f"{local} {r.choice(('at', '[at]', '(at)'))} {word()} {r.choice(('dot', '[dot]'))} {r.choice(('com', 'org', 'net'))}"
        if k == 1:
            return "email", "", f"{word()}{d(2)} @ {word()}.{r.choice(('com', 'org'))}"
        if k == 2:
            return "phone", r.choice(("call ", "phone: ", "tel ", "mobile ")), r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}"))
        if k == 3:
            return "phone", "", f"({d(3)}) {d(3)}-{d(4)}"
        if k == 4:
            s = card()
            return "card", r.choice(("card ", "visa: ", "")), f"{s[:4]}.{s[4:8]}.{s[8:12]}.{s[12:]}"
        if k > 6:  # with trunk or international prefixes, in groups
            return "phone", r.choice(("Tel. ", "tel: ", "Telefon ", "fax ", "ring ", "call ", "mobile: ", "dial ", "phone ")), r.choice((f"0{d(2)}/{d(7)}", f"0{d(3)} {d(3)} {d(4)}", f"00{d(2)} {d(2)} {d(4)} {d(4)}", f"00{d(2)} {d(3)} {d(6)}", f"0{d(4)}-{d(6)}", f"{d(3)} {d(3)} {d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"({d(3)}) {d(7)}"))
        if k == 5:
            return "ip", r.choice(("host ", "ip: ", "server ")), f" {r.choice(('.', '[.]', ' dot '))} ".replace("  ", " ").join(octet() for _ in range(4))
        return "ip", "", "[.]".join(octet() for _ in range(4))

    def negative() -> tuple[str, str, str]:
        k = r.randrange(8)
        s = d(16)
        if k == 0 and not luhn(s):
            return "card", r.choice(("", "id ", "order ")), s
        return r.choice(
            (
                ("phone", r.choice(("", "in ", "on ")), f"20{d(2)}-{r.randrange(10, 13)}-{r.randrange(10, 29)} 1{d(1)}"), ("phone", "", d(r.randrange(7, 13))),
                ("phone", r.choice(("score ", "at ", "from ", "won ")), f"{d(2)}-{d(2)}-{d(2)} {r.randrange(10, 24)}"), ("phone", r.choice(("order ", "part no. ", "ref ", "invoice ")), f"{d(4)}-{d(4)}-{d(2)}"), ("phone", "", f"{d(1)},{d(3)}"[:1] + f".{d(6)}"), ("phone", r.choice(("pages ", "lines ", "rows ")), f"{d(4)}-{d(4)}"),
                ("phone", r.choice(("in ", "years ", "")), f"19{d(2)} 20{d(2)}"), ("phone", r.choice(("at ", "lat ")), f"{d(2)}.{d(4)} {d(2)}.{d(4)}"), ("phone", "", f"{d(2)}/{d(2)}/20{d(2)} {d(2)}"), ("phone", r.choice(("sum ", "total ", "")), f"{d(3)}.{d(3)}.{d(3)}"), ("ip", r.choice(("version ", "v", "section ", "build ")), f"{d(1)}.{d(1)}.{d(1)}.{d(2)}"),
                ("card", "", d(r.randrange(13, 20))), ("email", "", f"{word()} at {word()} dot"), ("email", r.choice(("met ", "")), f"{word()} at {word()} dot {word()} {word()}"[:40]), ("phone", "of ", f"{d(1)}.{d(8)}"), ("ip", "version ", f"{r.randrange(300, 999)}.{d(3)}.{d(3)}.{d(3)}"),
                ("email", "", f"{word()} at {word()} . {word()}"), ("phone", "isbn ", f"978-{d(1)}-{d(5)}-{d(3)}-{d(1)}"), ("phone", "id ", d(8)), ("email", "", f"{word()} @ {word()}"),
            )
        )

    rows, y = [], []
    for n in range(count):
        text = r.choice(texts) if texts else "some words of a text"
        cut = r.randrange(len(text) + 1)
        kind, lead, body = positive() if n % 2 else negative()
        head, tail = text[max(0, cut - 100) : cut] + " " + lead, " " + text[cut : cut + 100]
        if kind == "card" and not n % 2 and luhn("".join(c for c in body if c.isdigit())):
            continue
        rows.append(features(head + body + tail, (kind, len(head), len(head) + len(body))))
        y.append(n % 2)
    return rows, y


#: Lines that held-out texts always have besides their own, so that each kind of data occurs among them.
STANDING = [f"write to a{k}.b@c{k}.org or +49 30 12{k}4567, host 10.0.{k}.1, card 4111 1111 1111 1111, on 2024-05-1{k % 10} 10:30 for 12345{k}" for k in range(100, 108)]


def respelled(r: random.Random, kind: str, s: str) -> str:
    """Fixed-format data in a spelling that no fixed pattern takes."""
    digits = "".join(c for c in s if c.isdigit())
    if kind == "email":
        local, _, domain = s.partition("@")
        return r.choice((f"{local} AT {domain.replace('.', ' DOT ')}", f"{local}<at>{domain}", f"{local.replace('.', ' dot ')} at {domain.replace('.', ' dot ')}", f"{local}{{at}}{domain.replace('.', '{dot}')}"))
    if kind == "ip":
        return r.choice((" . ".join(s.split(".")), "(.)".join(s.split(".")), "dot".join(s.split("."))))
    if kind == "card":
        return r.choice(("/".join(digits[i : i + 4] for i in range(0, len(digits), 4)), ". ".join(digits[i : i + 4] for i in range(0, len(digits), 4))))
    return r.choice((f"00{digits[:2]}-{digits[2:5]}-{digits[5:]}", f"(0{digits[2:5]}) {digits[5:8]} {digits[8:]}", f"0{digits[2:5]}-{digits[5:]}", f"00{digits}"))


def held_out_rows(texts: list[str], seed: int = 5) -> tuple[list[list[float]], list[int]]:
    """Candidates of texts: those that hold respelled data of the text (1), and those that overlap nothing that is marked (0)."""
    r = random.Random(seed)
    rows, y = [], []
    for t in texts:
        base, proposed = base_spans(t), candidates(t)
        for c, free in zip(proposed, free_of(proposed, base)):
            if free:
                rows.append(features(t, c))
                y.append(0)
        for kind, a, b in base:
            spelled = respelled(r, kind, t[a:b])
            head = t[max(0, a - AROUND) : a]
            whole, a = head + spelled + t[b : b + AROUND], len(head)
            for c in candidates(whole):
                if c[0] == kind and c[1] < a + len(spelled) and a < c[2] and 2 * min(c[2], a + len(spelled)) - 2 * max(c[1], a) > len(spelled):
                    rows.append(features(whole, c))
                    y.append(1)
    return rows, y


def train(texts: list[str]) -> PiiModel:
    """Trees on two thirds of the texts and made-up rows, calibration and thresholds on the other texts."""
    trees = grown([t for k, t in enumerate(texts) if k % 3 < 2])
    return settled(trees, margin_counts(trees, *held_out_rows(texts[2::3] + STANDING)))


def grown(texts: list[str]) -> BoostedTrees:
    """Trees on the texts' candidates and made-up rows."""
    rows, y = made_rows(texts)
    for t in texts:
        base = base_spans(t)
        for c in candidates(t):
            hit = [s for s in base if s[0] == c[0] and s[1] < c[2] and c[1] < s[2]]
            if hit or not any(c[1] < e and s < c[2] for _, s, e in base):
                plain = not hit and c[0] in ("phone", "email", "ip") and len(rows) % 2  # unmarked candidates are weak evidence: half of them
                if hit or c[0] == "card" or plain:
                    rows.append(features(t, c))
                    y.append(int(bool(hit)))
    x, target = np.array(rows, float), np.array(y, float)
    return BoostedTrees().fit(x, target)


def margin_counts(trees: BoostedTrees, rows: list[list[float]], y: list[int]) -> Counter:
    """Right and wrong candidates by (kind, step of the margin, right)."""
    if not rows:
        return Counter()
    x = np.array(rows, float)
    steps = np.rint(trees.margin(x) * STEPS).astype(int)
    return Counter(zip(x[:, 0].astype(int).tolist(), steps.tolist(), y))


def settled(trees: BoostedTrees, counts: Counter) -> PiiModel:
    """Calibration and thresholds from the counts of held-out candidates."""
    kind, step, right = (np.array(c) for c in zip(*counts))
    count, margin = np.array(list(counts.values()), float), step / STEPS
    trees.calibrate_margins(margin, right, count)
    p = trees.probability(margin)
    own = lambda k: kind == k
    return PiiModel(trees, {name: least_threshold(p[own(k)], right[own(k)], count=count[own(k)]) for k, name in enumerate(KINDS)})


def least_threshold(p: np.ndarray, y: np.ndarray, precision: float = PRECISION, count: np.ndarray | None = None) -> float:
    """A probability (0.5 or more) from which on the wanted precision holds, midway to the next candidate below; above 1 where none does."""
    order = np.argsort(-p, kind="stable")
    ranked = np.append(p[order], 0.0)
    count = np.ones(len(order)) if count is None else count[order]
    right = np.cumsum(y[order] * count) / np.cumsum(count)
    good = np.flatnonzero((right >= precision) & (ranked[1:] < ranked[:-1]))  # equal ones stand or fall together
    return max(0.5, float(ranked[good[-1]] + ranked[good[-1] + 1]) / 2) if len(good) else 1.01


def fit(docs: DataFrame, text: str = "text") -> PiiModel:
    """A model: trees from about ``SAMPLE`` documents with a digit or an @, picked by a hash of the text; calibration and thresholds from every held-out one."""
    every = docs.select(F.col(f"`{text}`").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]") | F.col("text").rlike("(?i)dot"))
    held = F.crc32(F.col("text").cast("binary")) % HELD == HELD - 1
    rows = every.where(~held & F.col("text").rlike("[0-9@]"))
    share = min(1.0, SAMPLE / max(1, rows.count()))
    picked = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < int(share * (1 << 40)) + 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows around some of a text's candidates."""
        for batch in batches:
            out = []
            for t in batch.column(0):
                text = t.as_py()
                windows = {text[max(0, a - 120) : b + 120][:WINDOW] for _, a, b in candidates(text) + base_spans(text)}
                out += sorted(windows, key=_picked)[:WINDOWS]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["text"])

    trees = grown(sorted({r["text"] for r in picked.mapInArrow(cut, "text string").collect()}, key=_picked))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for at in range(0, batch.num_rows, 256):
                rows, y = [], []
                for t in batch.column(0)[at : at + 256]:
                    more, right = held_out_rows([t.as_py()], _picked(t.as_py())[0])
                    rows += more
                    y += right
                found.update(margin_counts(trees, rows, y))
            columns = list(zip(*((*k, n) for k, n in found.items()))) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["kind", "step", "right", "n"])

    counts = every.where(held).mapInArrow(counted, "kind long, step long, right long, n long").groupBy("kind", "step", "right").agg(F.sum("n").alias("n"))
    found = margin_counts(trees, *held_out_rows(STANDING))
    for r in counts.collect():
        found[r["kind"], r["step"], r["right"]] += r["n"]
    return settled(trees, Counter(dict(sorted(found.items()))))


def _picked(text: str) -> tuple[int, str]:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")), text


def finder(model: PiiModel):
    """A column function text -> struct(base, spans)."""

    @F.arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        base, spans = [], []
        for at in range(0, len(texts), 512):
            b, s = model.scan_all([t.as_py() or "" for t in texts[at : at + 512]])
            base += b
            spans += s
        return found_array(base, spans)

    return find


def scan_documents(df: DataFrame, text: str = "text", model: PiiModel | None = None) -> DataFrame:
    """``df`` with ``base`` and ``spans``, arrays of (kind, start, end)."""
    return with_found(df, finder(model or fit(df, text))(F.col(f"`{text}`")))


def redact(df: DataFrame, text: str = "text", model: PiiModel | None = None, sign: str = SIGN) -> DataFrame:
    """``df`` with every span of ``text`` replaced; a null text stays null."""
    chosen = model or fit(df, text)

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        whole = [t.as_py() for t in texts]
        _, spans = chosen.scan_all([t or "" for t in whole])
        return pa.array([None if t is None else mask(t, s, sign) for t, s in zip(whole, spans)], pa.string())

    return df.withColumn(text, masked(F.col(f"`{text}`")))
