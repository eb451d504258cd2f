import gzip
import hashlib
import random

import numpy as np
import pytest

from cwlight.llm import ann, decontam, warc
from cwlight.llm.pieces import Encoder, encode_decode
from cwlight.llm.queries import ORACLE, QUERIES, tokenizer_path
from tests.llm.edge import PROSE, documents


# Nearest neighbours


def brute(rows, k, every):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for i, v in rows:
        if i % every == 0:
            d = np.sqrt(((x - np.array(v)) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_curve_visits_neighbours_in_turn():
    for d, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), axis=-1).reshape(-1, d)
        key = ann.hilbert(grid, bits)
        assert sorted(key.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 64)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(2000)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=50).collect()
    x = {i: np.float32(v).astype(float).tolist() for i, v in rows}
    want = brute(list(x.items()), 10, 50)
    found = sum(len({r.vec_id for r in got if r.query_id == q} & {i for i, _ in w}) for q, w in want.items())
    assert found >= 0.9 * 10 * len(want) and len(got) == 10 * len(want)


def test_whole_table_recall(spark, data):
    got = QUERIES["op2_nearest"](spark, data).collect()
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    want = brute(rows, 10, 100)
    assert {(r.query_id, r.rank): r.vec_id for r in got} == {(q, n + 1): i for q, w in want.items() for n, (i, _) in enumerate(w)}
    score = {(q, i): d for q, w in want.items() for i, d in w}
    assert all(abs(r.score - score[r.query_id, r.vec_id]) < 1e-12 for r in got)


def test_odd_vectors(spark):
    same = [1.0, 2.0]
    rows = [(i, same) for i in range(0, 40)] + [(100, [1.0, 2.5]), (200, None), (300, []), (400, [0.0, 0.0]), (500, [1.0, None]), (600, [float("nan"), 1.0]), (700, [float("inf"), 1.0]), (800, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS node", "2 AS rank", "3 AS v")
    got = {}
    for r in ann.nearest(df, k=3, every=20).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {0: [(1, 0.0), (2, 0.0), (3, 0.0)], 20: [(0, 0.0), (1, 0.0), (2, 0.0)], 100: [(0, 0.5), (1, 0.5), (2, 0.5)]}
    assert ann.nearest(df.limit(0)).count() == 0


# Decontamination


ITEM = "The committee of seven wizards quietly met at the old stone bridge, and nobody in the village knew what they had come to decide that night."


def test_exact_and_edited_passages(spark):
    rng = random.Random(1)
    words = lambda n: " ".join(f"w{rng.randrange(999)}" for _ in range(n))
    edited = ITEM.replace("wizards", "wizard").replace("stone", "stome")
    cut = ITEM[: len(ITEM) // 2]
    docs = documents(spark, [(1, f"{words(50)} {ITEM} {words(20)}"), (2, f"{words(9)}\n{edited.upper()}"), (3, words(500)), (4, f"{words(5)} {cut} {words(5)}"), (5, None), (6, ""), (7, ITEM.replace(" ", " \n ")), (8, "é " * 70 + ITEM), (9, words(20_000) + " " + ITEM)])
    bench = spark.createDataFrame([(10, ITEM), (11, None), (12, "short"), (13, PROSE)], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.matches(docs, bench).collect()}
    assert set(got) == {1, 2, 7, 8, 9} and {r.item_id for r in got.values()} == {10}
    text = {r.doc_id: r.text for r in docs.collect()}
    assert text[8][got[8].start : got[8].end] == ITEM.rstrip(".") and got[1].edits == 0 and 1 <= got[2].edits <= 2
    kept = decontam.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 6}


def test_alignment_equals_a_full_table():
    index = decontam.Index([(1, ITEM)])
    p = bytes(index.texts[0])
    rng = random.Random(3)
    for _ in range(60):
        t = bytearray(p)
        for _ in range(rng.randrange(9)):
            at = rng.randrange(len(t))
            op = rng.randrange(3)
            t[at : at + (op != 0)] = bytes([rng.choice(b"abcxyz")]) if op != 1 else b""
        text = b"xx yy " + bytes(t) + b" zz ww"
        row = [0] * (len(text) + 1)
        for i, ch in enumerate(p, 1):
            new = [i]
            for j, c in enumerate(text, 1):
                new.append(min(row[j - 1] + (c != ch), row[j] + 1, new[-1] + 1))
            row = new
        got = index.aligned(0, np.frombuffer(text, np.uint8), 0)
        assert (got[0] if got else None) == (min(row) if min(row) <= index.edits[0] else None)


def test_blocks_of_items_give_the_same_rows(spark, data):
    docs, bench = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "benchmark"))
    assert len(list(decontam.blocks(bench, 2000))) > 1
    want = sorted(map(tuple, QUERIES["op7_decontam"](spark, data).collect()))
    items = {r.item_id: r.text for r in bench.collect()}
    squash = lambda t: bytes(decontam.plain(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]).strip()
    exact = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if squash(t) in squash(r.text or "")}
    assert exact <= {w[:2] for w in want}
    assert decontam.matches(docs, bench.limit(0)).count() == 0


# WARC


def test_rows_equal_sql(spark, data, oracle, same):
    same(QUERIES["op8_warc"](spark, data).toPandas(), oracle(ORACLE["op8_warc"]))


def test_round_trip_of_odd_pages(spark):
    long = "<html>" + "é" * 200
    rows = [(3, "http://a/\r\nX: y", long), (1, None, long), (2, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", "x\r\n\r\ny" * 40), (1, "v", long), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS body", "3 AS first")
    packed = warc.archives(pages)
    got = warc.read_archives(packed).collect()
    assert len(got) == 9
    for r in got:
        assert r.record_type == ("revisit" if r.page_id == 3 else "response") and r.refers_to == (1 if r.page_id == 3 else None)
    whole = {(r.page_id, bytes(r.payload).decode()) for r in got if r.record_type == "response"}
    assert whole == {(i, t or "") for i, _, t in rows if i != 3}
    assert {r.payload_digest for r in got if r.page_id in (1, 3)} == {hashlib.sha256(long.encode()).hexdigest()}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_files_are_plain_gzip_members(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(20)], "page_id long, url string, html string")
    warc.export(warc.archives(pages), str(tmp_path)).collect()
    names = sorted(tmp_path.glob("*.warc.gz"))
    assert sum(gzip.decompress(n.read_bytes()).count(b"WARC/1.1\r\n") for n in names) == 20
    assert warc.read_files(spark, str(tmp_path / "*.warc.gz")).count() == 20


def test_damage_is_found():
    good = warc.record(1, "u", b"payload" * 30, hashlib.sha256(b"payload" * 30).hexdigest(), None)
    assert warc.read_record(good)[0] == 1
    for bad in (good.replace(b"payload", b"paYload", 1), good[:-1], good + b"x", good.replace(b"Content-Length: ", b"Content-Length: 1"), b"no record"):
        with pytest.raises(ValueError):
            warc.read_record(bad)
    with pytest.raises(ValueError):
        list(warc.members(iter([warc.member(good)[:-5]])))
    assert list(warc.members(iter([warc.member(good)[i : i + 7] for i in range(0, len(warc.member(good)), 7)]))) == [good]


# SentencePiece


def test_ids_equal_the_library(spark, data):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()] + ["", " ", "  ", " a", "a ", "▁", "a▁ b", "\n", " \n x  y ", "日本語 😀 \x00", "x   ", "</s> <unk> <0x0A>", "a" * 5000, " " * 300, "é́ ﻿"]
    encoder = Encoder(tokenizer_path())
    assert encoder.by_word
    for t in texts:
        ids = model.encode(t, add_eos=True)
        assert encoder.run(t) == (" ".join(map(str, ids)), len(ids), model.decode(ids)), t[:40]


def test_table_may_overflow(monkeypatch):
    from cwlight.llm import pieces

    texts = [PROSE, PROSE[::-1], "one two three"]
    want = [Encoder(tokenizer_path()).run(t) for t in texts]
    monkeypatch.setattr(pieces, "TABLE", 5)
    small = Encoder(tokenizer_path())
    assert [small.run(t) for t in texts] == want


def test_words_that_recur_are_segmented_once(monkeypatch):
    from cwlight.llm import pieces

    monkeypatch.setattr(pieces, "TABLE", 60)
    hot = [f"hot{i}" for i in range(10)]
    encoder = Encoder(tokenizer_path())
    texts = [" ".join([*hot, *(f"rare{k}x{i}" for i in range(5))]) for k in range(100)]
    got = [encoder.run(t) for t in texts]
    assert encoder.segmented == 10 + 500  # each distinct word once, though the table overflowed many times
    assert len(encoder.table) + len(encoder.old) <= 60 + 15
    assert got[-1] == Encoder(tokenizer_path()).run(texts[-1])


def test_token_rows(spark):
    got = encode_decode(documents(spark), tokenizer_path()).collect()
    assert len(got) == 12 and all(r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest() for r in got)
    assert {tuple(r.ids) for r in got if r.doc_id in (2, 3)} == {(2,)}
    assert encode_decode(documents(spark, []), tokenizer_path()).count() == 0


def test_a_revisit_must_find_its_response(spark):
    pages = spark.createDataFrame([(1, "u", "same " * 40), (2, "u", "same " * 40), (3, "u", "other " * 40)], "page_id long, url string, html string")
    records = warc.read_archives(warc.archives(pages), with_payload=False)
    assert sorted((r.page_id, r.refers_to) for r in warc.resolved(records).collect()) == [(1, None), (2, 1), (3, None)]
    with pytest.raises(Exception, match="refers to no response"):
        warc.resolved(records.where("page_id <> 1")).collect()


def offset_rows(n, spread):
    rng = np.random.default_rng(3)
    return [(i, (1e6 + spread * rng.normal(size=8)).tolist()) for i in range(n)]


def lists(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_vectors_far_from_the_origin_equal_brute_force(spark):
    rows = offset_rows(300, 1e-4)
    got = lists(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20, target=1.0))
    want = brute(rows, 10, 20)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items())
    assert hits >= 0.9 * 10 * len(want)
    score = {q: {i: d for i, d in brute(rows, 299, 20)[q]} for q in want}
    assert all(d == score[q][i] for q, w in got.items() for i, d in w)


def test_equidistant_vectors_come_by_their_ids(spark):
    rows = [(i, [float(j == i) for j in range(120)]) for i in range(120)]
    got = lists(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=40, target=1.0))
    assert set(got) == {0, 40, 80} and all(d == 2**0.5 for w in got.values() for _, d in w)
    # Every answer is the first by id of what was compared; with all compared it is the brute-force one.
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    full = ann.nearest(frame, k=119, every=40)
    assert lists(full) == {q: w for q, w in brute(rows, 119, 40).items()}


def test_recall_and_compared_pairs_at_two_sizes(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 256)
    monkeypatch.setattr(ann, "BLOCK_BITS", 8)
    rng = np.random.default_rng(1)
    share = []
    for n in (2000, 8000):
        centres = rng.normal(size=(n // 50, 24))
        x = centres[rng.integers(0, len(centres), n)] + 0.3 * rng.normal(size=(n, 24))
        rows = [(i, v) for i, v in enumerate(x.tolist())]
        got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=100).collect()
        want = brute(rows, 10, 100)
        hits = sum(len({r.vec_id for r in got if r.query_id == q} & {i for i, _ in w}) for q, w in want.items())
        assert hits >= 0.9 * 10 * len(want)
        share.append(np.mean([r.compared for r in got]) / n)
    assert share[0] < 0.5 and share[1] < 0.6 * share[0]


def test_repeated_ids_and_signed_zeros(spark):
    rows = [(1, [0.0, 1.0]), (2, [-0.0, 1.0]), (2, [-0.0, 1.0]), (20, [0.0, 1.0]), (20, [5.0, 1.0]), (3, [4.0, 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2, every=20).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(20, 1, 1, 0.0), (20, 1, 3, 1.0), (20, 2, 1, 5.0), (20, 2, 2, 0.0)]
