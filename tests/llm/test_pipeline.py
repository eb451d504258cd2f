"""The stages one after the other: which rows stay, and what becomes of their texts."""

import re

import corpus_pipeline
from cwlight.llm import pii, toxicity
from cwlight.llm.queries import tokenizer_path
from tests.llm.edge import documents
from tests.llm.test_near_dup import brute

ITEM = "The committee of seven wizards quietly met at the old stone bridge, and nobody in the village knew what they had come to decide that night."
OTHER = "Rain fell on the harbour all week while the ferry crew mended nets, drank coffee, argued about football and waited for the wind to turn."
THIRD = "A small museum near the station shows clocks that were built by hand, most of them still running, and one that has never been opened."


def written(folder, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def chain(spark, sf_dir, folder):
    """(stage, its input rows, its output) of every stage but the last, each written and read again; then the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/out-{name}")
        again = spark.read.parquet(f"{folder}/out-{name}")
        yield name, docs, again
        docs = again


def test_stages_on_the_test_tables(spark, data, tmp_path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    names = []
    for name, before, after in chain(spark, data, tmp_path):
        names.append(name)
        old, new = ({r.doc_id: r for r in x.collect()} for x in (before, after))
        assert len(old) == before.count() and len(new) == after.count() and set(new) <= set(old)
        if name == "pieces":
            for i, r in new.items():
                assert r.ids == model.encode(old[i].text or "", add_eos=True) and r.n_tokens == len(r.ids)
            continue
        assert after.columns == before.columns and [f.dataType for f in after.schema] == [f.dataType for f in before.schema]
        gone = set(old) - set(new)
        if name == "toxicity":
            labels = spark.read.parquet(f"{data}/labels.parquet")
            assert gone == {r.doc_id for r in toxicity.toxicity(before, labels).where("predicted = 1").collect()}
            assert gone  # how well it judges is measured on a larger table, in test_models
        if name == "near_dedup":
            component, _ = brute([(i, r.text) for i, r in old.items()])
            assert set(new) == {i for i, c in component.items() if i == c}
        if name == "decontamination":
            plain = lambda t: re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", (t or "").lower()).strip()
            items = [plain(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
            held = {i for i, r in old.items() if any(x in plain(r.text) for x in items)}
            assert held <= gone
        if name == "pii":
            found = {r.doc_id: r.redacted for r in pii.find(before, with_text=True).collect()}
            assert not gone and all(r.text == (None if old[i].text is None else found[i]) for i, r in new.items())
            assert not any(pii.base_spans(r.text or "") for r in new.values())
        else:
            assert all(new[i] == old[i] for i in new)
    assert names == ["toxicity", "near_dedup", "decontamination", "pii", "pieces"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, data).select("doc_id", "ids_sha256").collect())) == sorted((i, r.ids_sha256) for i, r in new.items())


def test_odd_tables(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(4000))
    rows = [
        (1, THIRD), (2, THIRD.upper()), (3, None), (4, ""), (4, ""), (5, " \n"), (6, f"so it began. {ITEM} and so on"), (7, OTHER), (7, "Write to anna.b@example.org or +49 170 1234567 before noon, as the office closes early today."),
        (8, long), (9, long + " end"), (None, "a row without an id"), (None, "a row without an id"), (10, "short"), (10, "short"),
    ]
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, ITEM), (2, None), (None, "")], "item_id long, text string")
    sf_dir = written(tmp_path, documents=documents(spark, rows), labels=labels, benchmark=bench)
    out = {name: (before, after) for name, before, after in chain(spark, sf_dir, tmp_path)}
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    assert texts(out["toxicity"][1]) == sorted(rows, key=repr)  # one label only: nothing to learn from, all stay
    one = [(1, THIRD), (3, None), (4, ""), (4, ""), (5, " \n"), rows[6], (7, OTHER), rows[8], (8, long), (None, rows[11][1]), (None, rows[11][1]), (10, "short")]
    kept = texts(out["near_dedup"][1])
    assert kept == sorted(one, key=repr)
    assert texts(out["decontamination"][1]) == [k for k in kept if k[0] != 6]
    assert all("@" not in (t or "") for _, t in texts(out["pii"][1])) and out["pii"][1].count() == len(kept) - 1
    last = out["pieces"][1].collect()
    assert len(last) == len(kept) - 1 and all(r.n_tokens == len(r.ids) >= 1 for r in last)


def test_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    sf_dir = written(tmp_path, documents=documents(spark, []), labels=labels, benchmark=bench)
    assert corpus_pipeline.run(spark, sf_dir).count() == 0
