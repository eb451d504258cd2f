"""Decontamination against a full alignment table, many occurrences, repetitive texts, several blocks."""

import random
import tracemalloc

import numpy as np

from cwlight.llm import decontam
from tests.llm.edge import documents

RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(RNG.randrange(2, 9))) for _ in range(300)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def edited(text, n):
    t = list(text)
    for _ in range(n):
        at = RNG.randrange(1, len(t) - 1)
        op = RNG.randrange(3)
        t[at : at + (op != 0)] = [RNG.choice("abcxyz")] if op != 1 else []
    return "".join(t)


def least(pattern, text):
    """(edits, start) of the best occurrence that ends at each place of ``text``, by a full table."""
    one = np.int64(1 << 32)
    t = np.frombuffer(text.encode(), np.uint8)
    at = np.arange(len(t) + 1, dtype=np.int64)
    row = at.copy()
    for ch in pattern.encode():
        new = row + one
        new[1:] = np.minimum(new[1:], row[:-1] + np.where(t == ch, 0, one))
        row = np.minimum.accumulate(new - at * one) + at * one
    return row >> 32, row & (one - 1)


def test_every_pair_and_region_within_budget(spark):
    items = {i: prose(RNG.randrange(6, 30)) for i in range(12)}
    budget = {i: int(decontam.RATE * len(t)) for i, t in items.items()}
    docs = []
    for d in range(60):
        parts = [prose(RNG.randrange(0, 40))]
        for _ in range(RNG.randrange(0, 4)):
            i = RNG.randrange(12)
            parts += [edited(items[i], RNG.randrange(0, budget[i] + 4)), prose(RNG.randrange(0, 30))]
        docs.append((d, " ".join(x for x in parts if x)))
    got = decontam.matches(documents(spark, docs), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    pairs, many = {(r.doc_id, r.item_id) for r in got}, 0
    for d, text in docs:
        for i, item in items.items():
            cost, start = least(item, text)
            ends = np.flatnonzero(cost <= budget[i])
            assert ((d, i) in pairs) == (len(ends) > 0), (d, i)
            mine = [r for r in got if (r.doc_id, r.item_id) == (d, i)]
            many += len(mine) > 1
            for r in mine:
                inside = ends[(start[ends] < r.end) & (ends > r.start)]
                assert r.edits == cost[inside].min()
            # Each occurrence belongs to one of the regions.
            for e in ends:
                assert any(start[e] < r.end and r.start < e for r in mine)
            assert all(a.end <= b.start for a, b in zip(*(sorted(mine, key=lambda r: r.start)[k:] for k in (0, 1))))
    assert len(pairs) > 30 and many > 0


def test_one_letter_takes_no_memory():
    index = decontam.Index([(1, "0" * 200)])
    text = np.full(60_000, 48, np.uint8)
    tracemalloc.start()
    found = decontam._matches(index, text, np.array([0, len(text)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(0, 0, 0, 60_000, 0)] and peak < 200 << 20


def test_overlapping_occurrences_are_one_region():
    assert decontam.regions([(1, 10, 20), (0, 12, 20), (0, 15, 25), (2, 24, 30), (0, 30, 40)]) == [(0, 12, 25), (0, 30, 40)]
    assert decontam.regions([]) == []


def test_blocks_and_odd_rows(spark, monkeypatch):
    a, b = prose(20), prose(20)
    short = "What is the capital of France?"
    docs = documents(spark, [(1, f"{a} {prose(5)} {b} {a}"), (1, f"{a} {prose(5)} {b} {a}"), (None, b), (3, None), (4, ""), (5, f"asked: {short} Paris")])
    bench = spark.createDataFrame([(10, a), (11, b), (11, b), (None, short), (13, None), (14, "too short")], "item_id long, text string").selectExpr("*", "1 AS start", "2 AS doc_id")
    want = sorted((r.doc_id or -1, r.item_id or -1, r.start, r.end, r.edits) for r in decontam.matches(docs, bench).collect())
    assert [w[:2] for w in want] == [(-1, 11)] * 2 + [(1, 10)] * 4 + [(1, 11)] * 4 + [(5, -1)]
    kept = sorted(map(tuple, decontam.drop_leaks(docs, bench).collect()))
    monkeypatch.setattr(decontam, "blocks", lambda benchmark, most=60, real=decontam.blocks: real(benchmark, most))
    assert len(list(decontam.blocks(bench))) > 2
    assert sorted((r.doc_id or -1, r.item_id or -1, r.start, r.end, r.edits) for r in decontam.matches(docs, bench).collect()) == want
    assert sorted(map(tuple, decontam.drop_leaks(docs, bench).collect())) == kept and {r[0] for r in kept} == {3, 4}
    assert decontam.drop_leaks(docs.limit(0), bench).count() == 0 and decontam.drop_leaks(docs, bench.limit(0)).count() == 6


def test_short_items_are_found_as_whole_words(spark):
    bench = spark.createDataFrame([(1, "Who wrote Faust?"), (2, "Faust"), (3, "?!"), (4, "an apple"), (5, "Who wrote Faust?"), (6, "ça va bien")], "item_id long, text string")
    texts = [(1, "He asked: who  wrote, FAUST and when"), (2, "who wrote faustina"), (3, "Faust! faust."), (4, "banan apple; an\napple"), (5, "who wrote"), (6, None), (7, "wrote Faust? Who"), (8, "oui, ça va BIEN 😀")]
    got = sorted((r.doc_id, r.item_id, r.start, r.end, r.edits) for r in decontam.matches(documents(spark, texts), bench).collect())
    assert got == [(1, 1, 10, 27, 0), (1, 2, 22, 27, 0), (1, 5, 10, 27, 0), (3, 2, 0, 5, 0), (3, 2, 7, 12, 0), (4, 4, 13, 21, 0), (7, 2, 6, 11, 0), (8, 6, 5, 15, 0)]
    # A word or two makes no leak; three do.
    assert sorted(r.doc_id for r in decontam.drop_leaks(documents(spark, texts), bench).collect()) == [2, 3, 4, 5, 6, 7]
