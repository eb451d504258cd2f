import random
import re

import numpy as np
import pytest

from cwlight.llm import jaccard_join as jj
from cwlight.llm.queries import ORACLE, QUERIES
from tests.llm.edge import ODD, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset({tuple(w)} if w else ())


def brute(rows, percent=85):
    """Smallest id reachable over links, for rows with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
    return " ".join(w)


def families(seed=1):
    """Near copies around centres, a chain in which each links to the next only, short texts and passages many share."""
    rng = random.Random(seed)
    texts = []
    for size, length, most in ((70, 200, 9), (30, 24, 2), (30, 9, 2), (20, 6, 1), (20, 1200, 40)):
        base = [f"w{rng.randrange(400)}" for _ in range(length)]
        texts += [edited(rng, base, rng.randrange(most + 1)) for _ in range(size)]
    chain = [f"v{rng.randrange(500)}" for _ in range(150)]
    for _ in range(14):
        chain = edited(rng, chain, 3).split()
        texts.append(" ".join(chain))
    passage = " ".join(f"p{i}" for i in range(50))
    texts += [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.choice([3, 8, 12, 200]))) for _ in range(60)]
    texts += ["one", "ONE", "one two", "one two three four", "ONE two three four", "", None, " \t"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def rows_of(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


def test_rows_equal_sql(spark, data, oracle, same):
    same(QUERIES["op13_jaccard"](spark, data).toPandas(), oracle(ORACLE["op13_jaccard"]))


@pytest.mark.parametrize("light,percent", [(None, 85), (0, 85), (40, 60)])
def test_families_equal_brute_force_on_either_side_of_the_boundary(spark, light, percent):
    rows = families()
    assert rows_of(jj.jaccard_components(documents(spark, rows), percent=percent, light=light)) == brute(rows, percent)


def test_order_of_shingles_changes_no_result(spark, monkeypatch):
    rows = families(2)
    monkeypatch.setattr(jj, "shingle_sketch", lambda docs, width, cells: np.zeros(cells, np.uint16))
    assert rows_of(jj.jaccard_components(documents(spark, rows))) == brute(rows)


def test_maps_and_sizes_never_rule_out_a_link(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(200):
        n = int(rng.integers(1, 400))
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        other = np.unique(np.concatenate([base[rng.random(n) < 0.93], rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 12))).astype(np.uint64)]))
        base = np.unique(base)
        both = len(np.intersect1d(base, other))
        rows.append((len(base), len(other), jj.parity(base).tolist(), jj.parity(other).tolist(), bool(100 * both >= 85 * (len(base) + len(other) - both))))
    df = spark.createDataFrame(rows, "na long, nb long, ma array<long>, mb array<long>, linked boolean").select("linked", jj.near_enough("na", "nb", "ma", "mb", 85).alias("open"))
    got = df.collect()
    assert sum(r.linked for r in got) > 20 and all(r.open for r in got if r.linked) and not all(r.open for r in got)


def test_first_shingles_of_partners_share_enough():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = set(rng.choice(60, rng.integers(2, 40), replace=False).tolist())
        b = {x for x in a if rng.random() < 0.93} | set(rng.choice(60, rng.integers(0, 3)).tolist())
        if b and 100 * len(a & b) >= 85 * len(a | b) and a != b:
            for common in (1, 2):
                x, y = (set(sorted(s)[: jj.first_of(len(s), 85, common)]) for s in (a, b))
                assert len(x & y) >= common


def test_odd_rows_repeated_ids_and_empty_tables(spark):
    rows = [r for r in ODD if r[0] is not None and r[0] not in (1, 6)]
    got = rows_of(jj.jaccard_components(documents(spark, rows)))
    assert got == brute(rows)
    every = jj.jaccard_components(documents(spark)).collect()
    assert len(every) == len(ODD)
    assert [r.component_id for r in every if r.doc_id is None] == [None]
    assert all(r.component_id == 1 for r in every if r.doc_id == 6)
    assert sorted(r.component_id for r in every if r.doc_id == 1) == [1, 1]
    assert jj.jaccard_components(documents(spark).limit(0)).count() == 0
