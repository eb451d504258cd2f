import random
import re

from cwlight.llm import near_dup
from cwlight.llm.queries import ORACLE, QUERIES
from tests.llm.edge import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """Smallest id reachable over links of similarity 0.75 or more, for rows with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
    return " ".join(w)


def family(size=90, seed=1):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = [(i, edited(rng, base, i % 7)) for i in range(size)]
    chain = [f"v{rng.randrange(500)}" for _ in range(120)]
    for i in range(size, size + 12):  # each links to the next only
        chain = edited(rng, chain, 2).split()
        rows.append((i, " ".join(chain)))
    return rows


def test_rows_equal_sql(spark, data, oracle, same):
    same(QUERIES["op10_minhash"](spark, data).toPandas(), oracle(ORACLE["op10_minhash"]))


def test_families_equal_brute_force_in_small_and_large_buckets(spark):
    rows = family()
    want, sizes = brute(rows)
    for small in (64, 3):
        got = near_dup.near_duplicates(documents(spark, rows), small=small).collect()
        assert {r.doc_id: r.component_id for r in got} == want
        assert {r.doc_id: r.n_shingles for r in got} == sizes
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_family_led_by_an_edited_copy_is_searched_by_rare_shingles(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    led = edited(rng, base, 2).split()
    rows = [(i, edited(rng, led, i % 2)) for i in range(40)] + [(i, edited(rng, base, 10)) for i in range(40, 100)]
    # Rows 98 and 99 link to each other only.
    rows[99] = (99, edited(rng, rows[98][1].split(), 1))
    tried, real = [], near_dup.confirm
    monkeypatch.setattr(near_dup, "confirm", lambda pairs, sets, percent: tried.append(pairs.count()) or real(pairs, sets, percent))
    want, _ = brute(rows)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(documents(spark, rows), small=20).collect()}
    assert got == want and want[99] == 98
    assert len(tried) == 2 and tried[1] <= 60


def test_odd_rows(spark):
    got = near_dup.near_duplicates(documents(spark)).collect()
    assert len(got) == 12
    by = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in got}
    n = len(shingles(documents(spark).where("doc_id = 6").first().text))
    assert by[2, 0] == (2, True) and by[3, 0] == (3, True) and by[4, 0] == (4, True)
    assert by[6, n] == (1, False) and by[1, n] == (1, True) and by[None, n] == (None, True)
    assert by[7, 1] == (7, True)
    assert near_dup.near_duplicates(documents(spark, [])).collect() == []


def test_estimate_is_collision_corrected(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    low = rng.integers(0, 2**32, (1, near_dup.HASHES), dtype=np.uint32)
    other = low.copy()
    other[0, :32] ^= 1
    frame = spark.createDataFrame([(near_dup.pack(low).view(np.int64)[0].tolist(), near_dup.pack(other).view(np.int64)[0].tolist())], "a array<long>, b array<long>")
    assert abs(frame.select(near_dup.estimate("a", "b").alias("e")).first().e - (0.75 - 1 / 16) / (1 - 1 / 16)) < 1e-12


def test_one_of_each_group_stays(spark):
    docs = documents(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words are here now")])
    out = near_dup.keep_one(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {1, 3}


def test_one_row_of_each_component_stays_where_ids_repeat(spark):
    a, b, near = (" ".join(f"{k}{i}" for i in range(60)) for k in "abn")
    b2 = b.replace("b59", "other")
    rows = [(3, a), (7, a), (7, b), (9, b2), (11, near), (11, near), (11, near.upper()), (5, None), (5, None), (6, " "), (None, a), (None, a)]
    docs = documents(spark, rows)
    out = near_dup.keep_one(docs)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert got == sorted([(3, a), (7, b), (11, near.upper()), (5, None), (5, None), (6, " "), (None, a), (None, a)], key=repr)
    assert near_dup.keep_one(documents(spark, [])).count() == 0


def test_sets_that_share_half_of_a_fingerprint_stay_apart(spark, monkeypatch):
    import pyspark.sql.functions as F

    rows = family(12)
    real = near_dup.signatures
    monkeypatch.setattr(near_dup, "signatures", lambda docs, width=5: real(docs, width).withColumn("node", F.lit(5).cast("long")))
    sets = near_dup.full_sets
    monkeypatch.setattr(near_dup, "full_sets", lambda docs, width=5: sets(docs, width).withColumn("node", F.lit(5).cast("long")))
    want, _ = brute(rows)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(documents(spark, rows)).collect()}
    assert got == want
