import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cwlight.llm import divergence as dv
from cwlight.llm import sketch
from cwlight.llm.queries import ORACLE, QUERIES
from tests.llm.edge import ODD

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=3, top=200):
    """The stated sums over every kept term of every group, one by one."""
    groups, docs, counts = set(), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        of = {s: [counts[lang, s][t] for t in kept] for x, s in groups if x == lang}

        def shares(c):
            return [1 + 10**9 * (x + 1) // (sum(c) + len(kept)) for x in c]

        p = {s: shares(c) for s, c in of.items()}
        q = shares([sum(c[i] for c in of.values()) for i in range(len(kept))])
        for s in of:
            pair = [(sum((a - b) ** 2 // b for a, b in zip(p[s], p[o])), o) for o in of if o != s]
            term = [((p[s][i] - q[i]) ** 2 // q[i], t) for i, t in enumerate(kept) if of[s][i] and p[s][i] > q[i]]
            for part, found in (("pair", pair), ("term", term)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.append((lang, s, part, item, value, rank))
    return sorted(out)


def mixed(seed=1, n=240):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = [f"{'abcdefgh'[min(7, rng.geometric(0.4))]}{'xyz'[rng.integers(3)] * int(rng.integers(1, 4))}" for _ in range(rng.integers(0, 30))]
        rows.append((" ".join(w.upper() if rng.random() < 0.2 else w for w in words) or None, [None, "en", "fr", "xx"][min(3, i % 5)], f"s{min(4, rng.geometric(0.5))}" if rng.random() < 0.9 else None))
    rows += [(f"lonely{i} straße 日本", "rare", f"s{i}") for i in range(2)] + [(None, "empty", "a"), ("", "empty", "b"), ("x " * 4000, "en", "s1")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1L AS doc_id", "'c' AS term", "2 AS n", "3 AS p0", "4 AS rank", "5 AS value")


def test_rows_equal_sql(spark, data, oracle, same):
    same(QUERIES["op12_divergence"](spark, data).toPandas(), oracle(ORACLE["op12_divergence"]))


@pytest.mark.parametrize("least,top", [(3, 200), (1, 4)])
def test_rows_equal_brute_force(spark, least, top):
    rows = mixed()
    assert sorted(tuple(r) for r in dv.divergence(frame(spark, rows).repartition(5), least, top).collect()) == brute(rows, least, top)


def test_odd_rows_and_empty_tables(spark):
    rows = [(t, "en" if i else None, f"s{(i or 0) % 3}") for i, t in ODD]
    assert sorted(tuple(r) for r in dv.divergence(frame(spark, rows)).collect()) == brute(rows)
    assert dv.divergence(frame(spark, rows).limit(0)).count() == 0


def test_sketch_never_underestimates_and_drops_lone_terms(spark):
    rows = mixed(2) + [(" ".join("q" + "abcdefghij"[i % 10] * (1 + i // 10) for i in range(j, j + 40)), "en", "s1") for j in range(0, 400, 40)]
    width = 1 << 16
    counts = dv.document_sketch(frame(spark, rows).na.fill("").repartition(7), width)
    true = defaultdict(Counter)
    for text, lang, _ in rows:
        true[lang or ""].update(set(TERM.findall((text or "").translate(LOWER))))
    low = 0
    for lang, seen in true.items():
        piece = dv._Piece((np.frombuffer(" ".join(seen).encode(), np.uint8), np.array([0, len(" ".join(seen).encode())])), pa.array([lang]), pa.array(["s"]))
        words = piece.words.to_pylist()
        estimate = counts[dv.cells(piece.keys(np.zeros(len(words), np.int64), np.arange(len(words))), width)].min(axis=0)
        assert all(e >= min(255, seen[w]) for e, w in zip(estimate.tolist(), words))
        low += int((estimate < 3).sum())
    assert low > 300


def test_terms_of_a_piece_are_made_distinct_by_sorting(monkeypatch):
    texts = ["b a b c", "", "a A b", "c"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    monkeypatch.setattr(np, "unique", lambda *a, **k: pytest.fail("np.unique hashes numbers, which costs more than a sort"))
    piece = dv._Piece((raw, offsets), pa.array(["en"] * 4), pa.array(["s"] * 4))
    words = piece.words.to_pylist()
    assert sorted((k // 3, words[k % 3]) for k in piece.once.tolist()) == [(0, "a"), (0, "b"), (0, "c"), (2, "a"), (2, "b"), (3, "c")]
    assert dv.distinct(np.array([5, -1, 5, 2, -1])).tolist() == [-1, 2, 5] and len(dv.distinct(np.zeros(0, np.int64))) == 0


def test_cells_stop_at_their_top():
    counts = np.zeros(8, np.uint8)
    sketch.add(counts, np.array([1, 1, 2]), np.array([200, 100, 7]))
    assert counts.tolist() == [0, 255, 7, 0, 0, 0, 0, 0]


def test_shares_of_counts_beyond_a_long_product(spark):
    df = spark.range(1).selectExpr("400000000000L AS c", "999999999999L AS n", "77L AS v").select(dv.share("c", "n", "v").alias("p"))
    assert df.first()["p"] == 1 + 10**9 * 400000000001 // (999999999999 + 77)
