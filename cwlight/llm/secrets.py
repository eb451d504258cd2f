"""Secret scans: fixed patterns, and a guess-cost dynamic program over values in credential context.

The fixed patterns give the base spans.  The method adds values that stand in a
wider credential context (a key, pass phrase, bearer or connection string) and
that would be hard to guess: the least sum of log2 guesses over all ways to cut
a value into words, dates, repeats, sequences, keyboard walks and brute-force
spans reaches ``MIN_BITS``.  A keyword may be the last part of a joined name
(DB_PWD, rsaPrivateKey).  A value that is an address of the web without a user
part is none.

Words are ranked by the number of documents that hold them, counted in Spark
over the whole corpus: the ``WORDS`` most frequent of those in at least
``SEEN`` documents, that is at most ``WORDS`` * ``LOOKBACK`` characters, go to
the tasks.  Letters that are no known word but read as prose, all their pairs
being usual inside words, cost some 1.5 bits a letter (Shannon's estimate) and
what tells such a run.

The search is linear in the text: context is found by one pass of a pattern
without nested repeats, a value ends at the first blank or quote, and the
dynamic program looks back at most ``LOOKBACK`` characters (a run of one kind,
also to its start); it stops where no end of the value can be cheap any more.

Defined cases: a null text counts as empty; repeated rows are judged alike; a
long value costs time in proportion.  Columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cwlight.llm.common import cut
from cwlight.llm.spans import Span, digest, listed, redacted

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "guess"]
ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words before a value that make it a credential, wider than the base pattern's.
CONTEXT = re.compile(
    r"(?:(?<![^\W_])|(?<=[a-z0-9])(?=[A-Z]))(?i:(?:pwd|pass|pass[ _-]?phrase|pass[ _-]?code|password|passwd|pin|secret|secret[ _-]?key|private[ _-]?key|access[ _-]?key|api[ _-]?key|auth|auth[ _-]?token|token|bearer|authorization|credentials?|client[ _-]?secret|signing[ _-]?key)"
    r"(?:[\"']?[ \t]{0,4}(?:[:=]|=>)[ \t]{0,4}(?:bearer[ \t]{1,4})?[\"'`]?|[ \t]{1,4}[\"'`]))([^\s\"'`,;<>]{6,})"
)
#: Every match of ASSIGN or CONTEXT holds one of these.
SIGNS = (":", "=", '"', "'", "`")
#: Bits of guessing that make a value a secret.
MIN_BITS = 42.0
LOOKBACK = 40
#: Words taken from the corpus at most, and the documents each must stand in.
WORDS, SEEN = 20_000, 5
#: Frequent words of pass phrases and prose, most frequent first; they stand before those of the corpus.
COMMON = (
    "the of and to in is for that with this from you are not was have all can will your password pass admin login user test "
    "welcome hello qwerty letmein monkey dragon master secret token key root guest default change changeme example sample demo "
    "value string none null true false required optional here below above field name mail phone number code world love money "
    "summer winter spring autumn monday sunday january june july december house green blue black white red apple orange"
).split()
#: Rows of the usual keyboards.
ROWS = ["`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "qwertzuiop", "yxcvbnm", "azertyuiop", "qsdfghjklm", "wxcvbn"]
NEXT = {(a, b) for row in ROWS for a, b in zip(row, row[1:])} | {(b, a) for row in ROWS for a, b in zip(row, row[1:])}
LEET = str.maketrans("@4380157$", "aaeooists")
#: Days with or without marks between their parts, in two orders, and years.
DATES = [
    re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])", re.ASCII),
    re.compile(r"(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d", re.ASCII),
    re.compile(r"(?:19|20)\d\d", re.ASCII),
]
DATE_BITS = math.log2(365 * 120)
#: Signs that usually stand between words.
MARKS = "-_./"
ADDRESS = re.compile(r"(?i:https?|ftp)://[^@]*$")


def _alphabet(ch: str) -> float:
    if "0" <= ch <= "9":
        return math.log2(10)
    if "a" <= ch <= "z" or "A" <= ch <= "Z":
        return math.log2(26)
    return math.log2(33) if ch.isascii() else math.log2(100)


#: Each letter with those that follow it inside English, German, French and Spanish words.
FOLLOWS = (
    "aabcdeghijklmnopqrstuvwyz badeilorsuy cacehiklmopqrtuv dabdehilnorstuw eabcdefghijklmnopqrstuvwxyz fabcefghiklnoprstuvz gabceghiklnoprstuvwz habceghiklmnopqrstuvwyz iabcdefghijlmnopqrstuvwxz "
    "ja keistw labcdegijlmnoqrstuwy mabeimopsu nabcdefghijklmnopqrstuvwz oabcdefghijklmnopqrstuvwz paefiloprstu qu rabcdeghijklmnopqrstuvwyz "
    "sabcdeghijlmnopqrstuwy tabceghiklmnopqrstuvwyz uabceghiklmnopqrstuvwxz vaeio waehior xaceilmopqrtvxy yabdehilnoprstw zabcdeghijklmnopqrstuvz "
).split()
PAIRS = {(w[0], b) for w in FOLLOWS for b in w[1:]}


def ranks(words: list[str]) -> dict[str, int]:
    """Rank of each word from 1, the fixed words first."""
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*COMMON, *words]))}


RANK = ranks([])


def usual(a: str, b: str) -> bool:
    """Whether two letters follow each other inside words; accents are left aside, letters beyond a to z follow any other."""
    if not (a.isalpha() and b.isalpha()):
        return False
    if not (a.isascii() and b.isascii()):
        a, b = (unicodedata.normalize("NFKD", x)[0] for x in (a, b))
    return not (a.isascii() and b.isascii()) or (a, b) in PAIRS


def segments(value: str, low: str, plain: str, j: int, runs: dict[str, int], known: dict[str, int], dates: dict[int, list[int]]) -> Iterator[tuple[int, float]]:
    """(start, bits) of every span that ends at ``j`` and is a word, date, repeat, sequence, walk, prose or a sign between words.

    ``runs`` holds where each run of one kind that reaches ``j`` starts; ``low``
    and ``plain`` are the value in lower case and with letters for look-alikes.
    """
    for kind, price in (("same", 3.0), ("walk", 6.0), ("step", 4.0)):
        first = runs[kind]
        for i in {first, *range(max(first, j - LOOKBACK), j - 2)} if j - first >= 3 else ():
            yield i, price + _alphabet(value[i]) + math.log2(j - i)
    first = runs["prose"]
    for i in {first, *range(max(first, j - LOOKBACK), j - 3)} if j - first >= 4 else ():
        yield i, 6 + 1.45 * (j - i)
    if value[j - 1] in MARKS:
        yield j - 1, 2.0
    for i in dates.get(j, ()):
        yield i, DATE_BITS
    for i in range(max(0, j - LOOKBACK), j - 2):
        rank = known.get(low[i:j])
        if rank is None and (rank := known.get(plain[i:j])) is not None:
            rank *= 8
        if rank is not None:
            case = value[i:j]
            extra = 0.0 if case == low[i:j] else 1.0 if case in (low[i:j].upper(), low[i:j].capitalize()) else float(j - i)
            yield i, math.log2(rank + 1) + extra
    for size in range(2, min(LOOKBACK, j) // 2 + 1):  # a unit said again
        if value[j - size : j] == value[j - 2 * size : j - size]:
            yield j - size, math.log2(2 * size)


def guess_bits(value: str, known: dict[str, int] = RANK, enough: float = math.inf) -> float:
    """log2 of the guesses for ``value`` by its cheapest segmentation; where that must reach ``enough``, some bound of at least that.

    best[j] is the least over i < j of best[i] + cost(i, j) + 1, the one bit
    telling where a segment ends.  A brute-force span pays its characters once
    and the one bit once, however long it is, so it is carried as a second
    state.
    """
    n = len(value)
    low = value.lower() if len(value.lower()) == len(value) else value
    plain = low.translate(LEET)
    dates: dict[int, list[int]] = {}
    for i in range(n):
        for pattern in DATES if "0" <= value[i] <= "9" else ():
            if m := pattern.match(value, i):
                dates.setdefault(m.end(), []).append(i)
    best = [0.0]
    brute = math.inf  # the cheapest way in which a brute-force span is open at j
    runs = dict.fromkeys(("same", "walk", "step", "prose"), 0)
    for j in range(1, n + 1):
        brute = min(brute, best[j - 1] + 1) + _alphabet(value[j - 1])
        if j > 1:
            a, b = low[j - 2], low[j - 1]
            delta = ord(b) - ord(a)
            if a != b:
                runs["same"] = j - 1
            if (a, b) not in NEXT:
                runs["walk"] = j - 1
            if abs(delta) != 1:
                runs["step"] = j - 1
            elif j - runs["step"] > 2 and delta != ord(a) - ord(low[j - 3]):
                runs["step"] = j - 2
            if not usual(a, b):
                runs["prose"] = j - 1
        best.append(min([brute, *(best[i] + 1 + bits for i, bits in segments(value, low, plain, j, runs, known, dates))]))
        # Every way to the end of the value passes one of these.
        if enough < math.inf and min(brute, *best[-LOOKBACK:], *(best[i] for i in runs.values())) >= enough:
            return enough
    return best[n]


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, non-overlapping within a kind."""
    out = []
    for m in ASSIGN.finditer(text) if ":" in text or "=" in text else ():
        if m.end(1) - m.start(1) >= 6:
            out.append((m.start(), m.end(), "assign"))
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def guessed_spans(text: str, min_bits: float = MIN_BITS, known: dict[str, int] = RANK) -> list[Span]:
    """Values in credential context whose guess cost reaches ``min_bits``."""
    out = []
    for m in CONTEXT.finditer(text) if any(x in text for x in SIGNS) else ():
        value = m[1].rstrip(".,:;!?)]}")
        if len(value) >= 6 and not ADDRESS.match(value) and guess_bits(value, known, min_bits) >= min_bits:
            out.append((m.start(1), m.start(1) + len(value), "guess"))
    return out


def frequent_words(docs: DataFrame, most: int = WORDS, seen: int = SEEN) -> list[str]:
    """The words that stand in most documents, most frequent first: at most ``most``, each in ``seen`` documents or more.

    A word is what is left of a run without blanks when the signs around it are
    taken off, if that is 3 to ``LOOKBACK`` letters; case is left aside.  Words
    come in whole classes of like frequency, a sixteenth of a doubling wide, so
    that what reaches the driver is a row for each class and then the words.
    """
    runs = F.split(F.lower(F.col("text").cast("string")), r"\s+")
    word = F.regexp_replace(F.col("run"), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    words = docs.select(F.explode(F.array_distinct(runs)).alias("run")).where(F.col("run").rlike(r"^[^\p{L}\p{N}]*\p{L}{3,%d}[^\p{L}\p{N}]*$" % LOOKBACK))
    counts = words.groupBy(word.alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= seen)
    counts = cut(counts.withColumn("class", F.floor(F.log2("n") * 16).cast("int")))
    total, least = 0, math.inf
    for r in counts.groupBy("class").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("class")).collect():
        total += r["n"]
        if total > most:
            break
        least = r["class"]
    found = counts.where(F.col("class") >= least).select("n", "word").collect() if least < math.inf else []
    return [r["word"] for r in sorted(found, key=lambda r: (-r["n"], r["word"]))]


def scan(docs: DataFrame, min_bits: float = MIN_BITS, with_text: bool = False, words: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: counts, digest of the base spans, all spans[, redacted text].

    ``words`` are known words, most frequent first; by default those of ``docs`` (``frequent_words``).
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks(frequent_words(docs) if words is None else words))

    def run(batches):
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows: list[list] = [[] for _ in range(7)]
                for text in part.column(1).to_pylist():
                    text = text or ""
                    base = base_spans(text)
                    spans = base + guessed_spans(text, min_bits, known)
                    found = listed(base, KINDS)
                    kinds = [k for _, _, k in base]
                    values = [*(kinds.count(k) for k in BASE), digest(found), listed(spans, KINDS), len(spans) - len(base)]
                    for column, value in zip(rows, [*values, redacted(text, spans) if with_text else ""]):
                        column.append(value)
                types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.string()]
                arrays = [part.column(0), *(pa.array(x, t) for x, t in zip(rows, types))][: 8 if with_text else 7]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "redacted"][: len(arrays)])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long" + ", redacted string" * with_text
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
