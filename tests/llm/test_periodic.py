import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from cwlight.llm import periodic
from cwlight.llm.queries import ORACLE, QUERIES
from tests.llm.edge import ODD, documents, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """Every run by its definition: maximal stretches of each period, less those a smaller period explains."""
    found = {}
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def echoed(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def expected(doc_id, words):
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha(told), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def texts(seed=3, n=160):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(6)):
            block = [rng.choice("abc") if rng.random() < 0.6 else f"w{rng.randrange(9)}" for _ in range(rng.randrange(1, 7))]
            parts += block * rng.randrange(1, 9) + block[: rng.randrange(len(block) + 1)]
            parts += [f"x{rng.randrange(20)}" for _ in range(rng.randrange(5))]
        out.append((i, rng.choice([" ", "  ", "\t", "\n"]).join(parts)))
    return out


def test_rows_equal_sql(spark, data, oracle, same):
    same(QUERIES["op11_periodic"](spark, data).toPandas(), oracle(ORACLE["op11_periodic"]))


@pytest.mark.parametrize("pairs", [7, 1 << 20])
def test_rows_equal_brute_force(spark, monkeypatch, pairs):
    rows = texts()
    for i, text in rows:
        ids, bounds, _ = periodic.numbered(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        monkeypatch.setattr(periodic, "PAIRS", pairs)
        assert list(zip(*(x.tolist() for x in periodic.runs_of(ids, bounds)))) == brute(text.split())
    got = sorted(tuple(r) for r in periodic.runs_in(documents(spark, rows), False, False).collect())
    assert got == [expected(i, t.split()) for i, t in rows]


def test_echoes_and_runs_of_the_query(spark):
    rows = texts(5)
    got = sorted(tuple(r) for r in periodic.runs_in(periodic.with_echoes(documents(spark, rows)), False, False).collect())
    assert got == [expected(i, echoed(i, t.split())) for i, t in rows]
    assert sum(echoed(i, t.split()) != t.split() for i, t in rows) > 5


def test_runs_across_many_rows_stay_in_their_row():
    ids = np.array([1] * 5 + [1] * 7 + [2, 3] * 4, np.int32)
    got = periodic.runs_of(ids, np.array([0, 5, 12, 12, 20]))
    assert list(zip(*(x.tolist() for x in got))) == [(5, 7, 1), (12, 8, 2)]


def test_a_hash_that_errs_costs_time_and_no_result(monkeypatch):
    rng = np.random.default_rng(2)
    ids = np.concatenate([np.tile(rng.integers(0, 4, 5), 6), rng.integers(0, 3, 90), np.tile([1, 2], 9)]).astype(np.int32)
    want = brute(ids.tolist())
    monkeypatch.setattr(periodic._Stretches, "same", lambda self, at, shift, size: np.ones(len(at), bool))
    assert list(zip(*(x.tolist() for x in periodic.runs_of(ids, np.array([0, len(ids)]))))) == want
    assert list(zip(*(x.tolist() for x in periodic.by_words(ids)))) == want


def test_long_text_in_bounded_pairs():
    rng = np.random.default_rng(4)
    ids = np.concatenate([rng.integers(0, 50, 100_000), np.tile(rng.integers(0, 50, 9_000), 11), rng.integers(0, 50, 1000)]).astype(np.int32)
    start, length, period = periodic.runs_of(ids, np.array([0, len(ids)]))
    at = int(np.argmax(length))
    assert period[at] == 9_000 and length[at] >= 99_000 and start[at] <= 100_000


def test_odd_rows_and_empty_tables(spark):
    docs = documents(spark)
    got = periodic.runs_in(docs).collect()
    want = sorted((expected(i, WORD.findall(t or "")) for i, t in ODD), key=repr)
    assert rows_of(periodic.runs_in(docs, False, False)) == want
    assert all(len(r.runs) == r.n_runs and hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256 for r in got)
    assert periodic.runs_in(periodic.with_echoes(docs.limit(0))).count() == 0
    assert periodic.with_echoes(docs).count() == len(ODD)
