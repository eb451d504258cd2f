"""Personal data: fixed patterns, and candidates judged by boosted trees.

The fixed patterns give the base spans.  Beside them, high-recall generators
propose overlapping spans (numbers with separators, account numbers); boosted
trees score each by its format and by the words before it, and a span is
selected where the score passes its kind's threshold.  A run of numbers, such as
a list or a row of a table, has no greatest length: its shapes are sought in the
run, between its commas and colons, between its blanks, and at each of its
groups.  Thresholds
are set on held-out examples to a precision of ``PRECISION``; of overlapping
selected spans the best scored stays, and base spans go before all others.

No table marks personal data, so the trees learn from examples composed here,
``EXAMPLES`` of them: numbers of each kind in fitting and in neutral words, and
numbers that look alike (versions, orders, amounts, dates, measures).

Every pattern is linear in the text: a run of digits or of address characters
is entered once, at its start, and the shapes sought in a run are bounded.

Defined cases: a null text counts as empty.  Columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cwlight.llm.boost import Boosted, sigmoid
from cwlight.llm.spans import Span, digest, listed, redacted

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "ssn", "iban"]
EXAMPLES, PRECISION = 6000, 0.995

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: The generators: any run of digits and number signs, and account numbers.
NUMBER = re.compile(r"(?<![0-9A-Za-z+(])[+(]{0,2}[0-9](?:[\x20().,/:-]{0,2}[0-9])++")
ACCOUNT = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])")
SHAPES = {
    "phone": re.compile(r"(?:\+?[0-9]{1,3}[ .-])?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+?[0-9]{2,4}(?:[ ./-][0-9]{2,4}){2,4}"),
    "ssn": re.compile(r"[0-9]{3}([ -])[0-9]{2}\1[0-9]{4}"),
    "card": re.compile(r"[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5}"),
}
#: Where one number of a list may end, and shapes that may begin at any group: behind no digit, a digit and its sign, or a country.
PARTS = (re.compile(r"[^,:]+"), re.compile(r"[^\x20]+"))
GROUPS = [
    (kind, re.compile(rf"(?<![0-9(+])(?<![0-9][./-])(?<!\+[0-9]\x20)(?<!\+[0-9][0-9]\x20)(?<!\+[0-9][0-9][0-9]\x20)(?=({shape})(?![0-9]))"))
    for kind, shape in (
        ("phone", r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}"),
        ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3} [0-9]{2} [0-9]{4}"),
        ("card", r"[0-9]{4}(?:[ -]?[0-9]{4}){3}|[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5}"),
    )
]
#: Words before a number that speak for or against it.
WORDS = {
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "whatsapp", "contact", "reach", "telefon", "handy", "móvil", "téléphone"),
    "ssn": ("ssn", "social", "security", "tax", "insurance", "identity", "taxpayer"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "payment", "paid", "cc", "karte", "carte", "tarjeta"),
    "iban": ("iban", "account", "bank", "transfer", "konto", "compte", "cuenta"),
    "against": ("version", "order", "invoice", "item", "page", "isbn", "serial", "build", "ref", "total", "price", "date", "room", "section", "part", "ticket", "tracking", "model", "release", "lines", "score"),
}
FIELD = re.compile(r"\w+")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost matches of the address pattern: before each @ the run of address characters, behind it a domain."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end(), "email"))
        # The next local part starts behind this match, or behind this @.
        last = m.end() if m else at + 1
        at = text.find("@", last)
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, non-overlapping within a kind."""
    out = _emails(text) if "@" in text else []
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(int(x) <= 255 for x in (y.lstrip("0")[:4] or "0" for y in m[0].split("."))):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 10 <= sum(ch.isdigit() for ch in m[0]) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return out


def candidates(text: str) -> list[Span]:
    """Overlapping proposals of the generators."""
    out: dict[Span, None] = {}
    for m in NUMBER.finditer(text) if DIGIT.search(text) else ():
        at = m.start()
        if m.end() - at < 9:  # no shape is shorter than 8, none of 8 can be cut
            parts = [(at, m[0])]
        else:
            parts = [(at, m[0]), *((at + x.start(), x[0]) for part in PARTS for x in part.finditer(m[0]) if len(x[0]) < len(m[0]))]
            for kind, group in GROUPS:
                out.update(((at + x.start(1), at + x.end(1), kind), None) for x in group.finditer(m[0]))
        for start, part in parts:
            for kind, shape in SHAPES.items():
                out.update(((start + x.start(), start + x.end(), kind), None) for x in shape.finditer(part))
    out.update(((m.start(), m.end(), "iban"), None) for m in ACCOUNT.finditer(text))
    # The last figure of a clock is no part of the number behind it.
    last: dict[int, int] = {}
    for a, b, _ in out:
        last[b] = max(a, last.get(b, a))
    return [s for s in out if s[0] == last[s[1]] or text[s[0] - 1 : s[0]] != ":" or not DIGIT.match(text, s[0] - 2 if s[0] > 1 else s[0] - 1)]


def features(text: str, span: Span) -> list[float]:
    """Format of the span and the words around it."""
    a, b, kind = span
    s = text[a:b]
    digits = "".join(ch for ch in s if "0" <= ch <= "9")
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    before = [w.lower() for w in FIELD.findall(text[max(0, a - 40) : a])][-4:]
    after = text[b : b + 2]
    moved = (s[4:] + s[:4]).replace(" ", "") if kind == "iban" else ""
    return [
        float(KINDS.index(kind)), float(b - a), float(len(digits)), float(len(groups)), float(max(groups)), float(min(groups)), float(groups[0]), float(groups[-1]),
        float(s.startswith("+")), float("(" in s), float(s.count(" ")), float(s.count("-")), float(s.count(".")), float(s.count("/")),
        float(luhn(digits)), float(int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 if moved.isalnum() and moved.isascii() else 0), float(digits[0]), float(len(set(digits))),
        float(digits[:3] in ("000", "666") or digits[:1] == "9"),
        *(float(any(w.startswith(k) for w in before for k in keys)) for keys in WORDS.values()),
        float(a > 0 and text[a - 1] in "$€£#.-/:"), float(after[:1] in (".", "/", ":", "-", "%") and after[1:].isdigit()), float(after[:1].isalpha()),
    ]


def _examples(n: int, seed: int = 7) -> tuple[list[tuple[str, Span]], np.ndarray]:
    """Composed texts with one candidate each, and whether it is personal."""
    rng = np.random.default_rng(seed)
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]

    def card() -> str:
        head = pick(["4", "51", "55", "6011", "37"])
        body = head + num((15 if head == "37" else 16) - len(head) - 1)
        body += next(d for d in "0123456789" if luhn(body + d))
        return body if rng.random() < 0.4 else pick([" ", "-"]).join(body[i : i + 4] for i in range(0, len(body), 4))

    def iban() -> str:
        country, body = pick(["DE", "FR", "ES", "NL"]), num(pick([14, 18, 20]))
        check = 98 - int(body + str(int(country[0], 36)) + str(int(country[1], 36)) + "00") % 97
        whole = f"{country}{check:02d}{body}"
        return whole if rng.random() < 0.5 else " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))

    area = lambda: f"{rng.integers(201, 990)}"
    good = {
        "phone": lambda: pick([f"({area()}) {num(3)}-{num(4)}", f"{area()}-{num(3)}-{num(4)}", f"{area()}.{num(3)}.{num(4)}", f"+{rng.integers(1, 99)} {area()} {num(3)} {num(4)}", f"0{rng.integers(10, 99)} {num(2)} {num(2)} {num(2)} {num(2)}"]),
        "ssn": lambda: f"{rng.integers(100, 660)}-{rng.integers(10, 99)}-{rng.integers(1000, 9999)}",
        "card": card,
        "iban": iban,
    }
    bad = [
        lambda: f"{area()} {num(3)} {num(4)}", lambda: f"{rng.integers(1990, 2030)}-{num(2)}-{num(2)} {num(2)}:{num(2)}", lambda: num(16), lambda: f"{num(3)}.{num(3)}.{num(4)}", lambda: f"{num(4)} {num(4)} {num(4)} {num(4)}",
        lambda: f"{num(2)}.{num(2)}.{num(4)}", lambda: f"978-{num(1)}-{num(3)}-{num(5)}-{num(1)}", lambda: num(10), lambda: f"{num(3)} {num(2)} {num(4)}", lambda: f"{num(3)}/{num(3)}/{num(4)}", lambda: f"DE{num(2)} {num(4)} {num(4)} {num(4)} {num(2)}",
    ]
    neutral = ["", "in", "the", "of", "und", "de", "la", "with", "to", "is"]
    rows, labels = [], []
    while len(rows) < n:
        if rng.random() < 0.45:
            kind = pick(list(good))
            value, label = good[kind](), 1
            # A bare number is personal by its words; others also by their form.
            bare = value.isdigit() or value.count(" ") and kind == "phone" and not value.startswith(("+", "("))
            word = pick(WORDS[kind]) if bare or rng.random() < 0.6 else pick(neutral)
        else:
            value, label, kind = pick(bad)(), 0, None
            word = pick(WORDS["against"]) if rng.random() < 0.5 else pick(neutral)
        text = f"{pick(neutral)} {word}{pick([' ', ': ', ' no. '])}{value} {pick(neutral)}"
        for s in candidates(text):
            # A whole value proposed as another kind is an example against that kind.
            if label == 0 or s[1] - s[0] >= len(value) - 1:
                rows.append((text, s))
                labels.append(label * (s[2] == kind))
    return rows[:n], np.array(labels[:n])


class Apart:
    """Ranges that do not overlap, in order, so that a text with many spans costs a search for each."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)
        return i == 0 or self.ends[i - 1] <= a

    def cover(self, a: int, b: int) -> None:
        """Adds a range; one that overlaps others must come behind their starts."""
        if self.free(a, b):
            i = bisect_left(self.starts, a)
            self.starts.insert(i, a)
            self.ends.insert(i, b)
        else:
            self.ends[-1] = max(self.ends[-1], b)


class Judge:
    """Boosted trees and a threshold for each kind."""

    def __init__(self, examples: int = EXAMPLES, precision: float = PRECISION) -> None:
        rows, y = _examples(examples)
        x = np.array([features(t, s) for t, s in rows])
        held = np.arange(len(y)) % 4 == 0
        self.trees = Boosted().fit(x[~held], y[~held])
        p, kind = sigmoid(self.trees.margin(x[held])), x[held, 0]
        self.threshold = {}
        for k, name in enumerate(KINDS):
            of = kind == k
            order = np.argsort(-p[of], kind="stable")
            right = np.cumsum(y[held][of][order]) / np.arange(1, of.sum() + 1)
            enough = np.flatnonzero(right >= precision)
            self.threshold[name] = max(0.5, float(p[of][order][enough[-1]])) if len(enough) else 2.0

    def select(self, texts: list[str], taken: list[list[Span]]) -> list[list[Span]]:
        """The spans to add for each text, apart from those already taken."""
        rows, x = [], []
        for i, (text, base) in enumerate(zip(texts, taken)):
            used = Apart()
            for a, b, _ in sorted(base):
                used.cover(a, b)
            for s in candidates(text):
                if used.free(s[0], s[1]):
                    rows.append((i, s))
                    x.append(features(text, s))
        out: list[list[Span]] = [[] for _ in texts]
        if rows:
            score = sigmoid(self.trees.margin(np.array(x)))
            held = [Apart() for _ in texts]
            for j in np.argsort(-score, kind="stable").tolist():
                i, (a, b, k) = rows[j]
                if score[j] >= self.threshold[k] and held[i].free(a, b):
                    held[i].cover(a, b)
                    out[i].append((a, b, k))
        return out


@lru_cache(maxsize=1)
def judge() -> Judge:
    return Judge()


def find(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: counts, digest of the base spans, all spans[, redacted text]."""
    model = judge()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [t or "" for t in part.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                more = model.select(texts, base)
                rows: list[list] = [[] for _ in range(8)]
                for text, b, m in zip(texts, base, more):
                    kinds = [k for _, _, k in b]
                    found = listed(b, KINDS)
                    for column, value in zip(rows, [*(kinds.count(k) for k in BASE), digest(found), listed(b + m, KINDS), len(m), redacted(text, b + m) if with_text else ""]):
                        column.append(value)
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.string()]
                arrays = [part.column(0), *(pa.array(x, t) for x, t in zip(rows, types))][: 9 if with_text else 8]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added", "redacted"][: len(arrays)])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long" + ", redacted string" * with_text
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the found spans of each text replaced by their kind; n_chars follows, where there is one."""
    model = judge()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                place = part.schema.get_field_index("text")
                held = part.column(place).to_pylist()
                texts = [t or "" for t in held]
                base = [base_spans(t) for t in texts]
                more = model.select(texts, base)
                new = [None if h is None else redacted(t, b + m) for h, t, b, m in zip(held, texts, base, more)]
                yield part.set_column(place, "text", pa.array(new, pa.string()))

    out = docs.withColumn("text", F.col("text").cast("string"))
    out = out.mapInArrow(run, out.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
