import hashlib
import random
import re
from collections import Counter

from cwlight.llm import substring
from cwlight.llm.queries import ORACLE, QUERIES
from cwlight.llm.substring import remove_repeats
from tests.llm.edge import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for a in range(len(w) - window + 1):
            if seen[tuple(w[a : a + window])] > 1:
                gone |= set(range(a, a + window))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def test_rows_equal_sql(spark, data, oracle, same):
    same(QUERIES["op6_substring"](spark, data).toPandas(), oracle(ORACLE["op6_substring"]))


def test_odd_rows_equal_brute_force(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(r) for r in remove_repeats(docs, 35).collect()), key=repr) == brute(rows, 35)
    assert remove_repeats(documents(spark, []), 35).collect() == []


def test_passages_at_all_offsets_equal_brute_force(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(40)]
    rows = []
    for i in range(40):  # the passage, whole or cut, behind i words, and in the midst of its like
        part = passage[: rng.choice([20, 34, 35, 36, 40])]
        rows.append((i, " ".join([word() for _ in range(i)] + part + [word() for _ in range(rng.randrange(30))])))
    rows.append((99, " ".join(["la"] * 120)))
    for window in (35, 8, 1):
        assert sorted((tuple(r) for r in remove_repeats(documents(spark, rows), window).collect()), key=repr) == brute(rows, window)


def test_sizes_of_cells_do_not_change_the_rows(spark, monkeypatch):
    rng = random.Random(7)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(50))
    rows = [(i, " ".join([passage] * (i % 3) + [f"w{rng.randrange(10**6)}" for _ in range(30)] + [passage] * (i % 2))) for i in range(40)]
    want = sorted((tuple(r) for r in remove_repeats(documents(spark, rows), 35).collect()), key=repr)
    monkeypatch.setattr(substring, "CELL_PROBES", 1)
    for pack, part in ((500, 900), (5000, 300)):
        monkeypatch.setattr(substring, "PACK_BYTES", pack)
        monkeypatch.setattr(substring, "RANGE_BYTES", part)
        assert sorted((tuple(r) for r in remove_repeats(documents(spark, rows), 35).collect()), key=repr) == want == brute(rows, 35)


def test_cells_grow_with_the_square_root():
    assert substring.cell_sizes(30 * 10**9) == (substring.PACK_BYTES, substring.RANGE_BYTES)
    for total in (10**12, 10**14):
        pack, part = substring.cell_sizes(total)
        assert total / 6 / (total / pack * (total / part)) >= 0.99 * substring.CELL_PROBES


def pack_of(texts):
    import pyarrow as pa

    return substring._Pack(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}))


def test_a_frequent_passage_is_one_probe_of_each_pack():
    import numpy as np

    rng = random.Random(9)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(60))
    other = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    tables = [pack_of([f"{other()} {passage}" if i % 3 == 0 else other() for i in range(60)]) for _ in range(5)]
    cells = [substring.block_probes(k, p, 18, 35, 1) for k, p in enumerate(tables)]
    owners, keys = [], []
    for k, c in enumerate(cells):
        owner, _, (key,) = substring._opened(c, [np.uint32])
        owners.append(np.full(len(owner), k))
        keys.append(key >> np.uint32(2))
    counts = Counter(np.concatenate(keys).tolist())
    assert max(counts.values()) == 5 and sum(v == 5 for v in counts.values()) == 43  # 60 - 17 runs, once a pack
    # The pack finds all its places from the first one.
    p = tables[0]
    told = np.flatnonzero(np.isin(p.hashes, p.hashes[p.ends - p.starts > 0][40:41]))[:1]
    windows = substring.repeated_windows(p, told, 35)
    assert len(windows) == 20 and (p.hashes[windows] == p.hashes[told[0]]).all()


def test_windows_that_agree_in_one_hash_only_are_kept_apart(monkeypatch):
    import numpy as np

    import pyarrow as pa

    second = np.array([2, 4, 6], np.uint64)
    cells = [substring._cells(k, np.array([10], np.int64), np.array([1 << 40], np.uint64), [np.array([7], np.uint64), second[k : k + 1]], 1) for k in range(3)]
    assert substring._window_hits(pa.concat_tables(cells)).num_rows == 0
    again = substring._cells(3, np.array([5], np.int64), np.array([1 << 40], np.uint64), [np.array([7], np.uint64), second[:1]], 1)
    assert sorted(substring._window_hits(pa.concat_tables([*cells, again]))["pack"].to_pylist()) == [0, 3]


def test_repeated_rows_are_dealt_into_many_packs(spark, monkeypatch):
    monkeypatch.setattr(substring, "CELL_PROBES", 1)
    monkeypatch.setattr(substring, "PACK_BYTES", 2000)
    monkeypatch.setattr(substring, "RANGE_BYTES", 2000)
    text = " ".join(f"w{i}" for i in range(50))
    docs = documents(spark, [(1, text)] * 40 + [(2, "w1 w2")])
    out = remove_repeats(docs, 35, with_text=False)
    assert sorted((r.doc_id, r.n_removed) for r in out.collect()) == [(1, 50)] * 40 + [(2, 0)]
    assert "ReusedExchange" in out._jdf.queryExecution().toString()
