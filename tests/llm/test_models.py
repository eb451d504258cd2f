import numpy as np
import pyarrow as pa

from cwlight.llm import cnn, common, gru, langid, toxicity
from cwlight.llm.boost import Boosted, sigmoid
from cwlight.llm.queries import QUERIES
from tests.llm.edge import documents


def test_network_gradients_equal_differences():
    net = gru.ByteTagger(3, hidden=3, seed=1)
    for p in net.parameters():
        p[...] = p.astype(np.float32)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (4, 6)).astype(np.uint8), np.array([0, 1, 2, 1])

    def loss():
        return -np.log(net.probabilities(x)[:, np.arange(4), y]).mean()

    steps = np.ascontiguousarray(x.T)
    a, ma = net.ahead.run(steps, True)
    b, mb = net.behind.run(steps[::-1], True)
    assert np.allclose(a, net.ahead.states(steps), atol=1e-6)
    d = net._scores(a, b)
    d[:, np.arange(4), y] -= 1
    d /= d.shape[0] * 4
    k = net.ahead.hidden
    grads = net.ahead.back(ma, d @ net.top[:k].T) + net.behind.back(mb, (d @ net.top[k:].T)[::-1])
    for p, g in zip(net.ahead.parameters() + net.behind.parameters(), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, eps = p[at], 1e-2
        p[at] = old + eps
        up = loss()
        p[at] = old - eps
        down = loss()
        p[at] = old
        assert abs((up - down) / (2 * eps) - g[at]) < 2e-3


def test_language_of_documents(spark, data):
    got = QUERIES["op1_langid"](spark, data).toPandas()
    truth = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").toPandas().merge(got, on="doc_id")
    held = truth[truth.held_out]
    assert len(got) == len(truth) and (held.lang == held.lang_pred).mean() >= 0.9
    assert got.score.between(0, 1).all()


def test_language_of_odd_rows(spark):
    names, net = langid.learn([("en", b"the and of"), ("de", b"der und die")], rounds=3)
    got = langid.predict(documents(spark), names, net).collect()
    assert len(got) == 12 and {r.lang_pred for r in got if r.doc_id in (2, 3, 4)} == {"und"}
    assert all(r.lang_pred in names for r in got if r.doc_id in (5, 6, 8))
    assert {r.lang_pred for r in langid.predict(documents(spark), *langid.learn([])).collect()} == {"und"}
    assert langid.languages(documents(spark, [])).count() == 0


def test_positions_do_not_depend_on_neighbours():
    names, net = langid.learn([("en", b"the and of"), ("de", b"der und die")], rounds=3)
    texts = ["abc", "", "x" * 1000, "the end"]
    raw, off = common.text_buffer(pa.array(texts))
    alone = [langid.pooled(net, *common.text_buffer(pa.array([t])))[0] for t in texts]
    assert np.allclose(langid.pooled(net, raw, off), alone, atol=1e-6)


def test_convolution_equals_a_plain_loop():
    net = cnn.TextCNN(20, 2, dim=4, filters=3, seed=2)
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 20, (n, 2)) for n in (5, 1, 0, 3)]
    z, p = net.scores(net.tables(), np.concatenate(docs), np.cumsum([0, 5, 1, 0, 3]))
    for i, d in enumerate(docs):
        e = np.concatenate([net.words[d].sum(axis=1), np.zeros((cnn.PAD, 4))])
        h = [max(sum(e[t + j] @ k[j][:, f] for j in range(w)) for t in range(len(e) - w + 1)) for w, k in zip(cnn.WIDTHS, net.kernel) for f in range(3)]
        assert np.isclose(z[i], np.maximum(np.array(h) + net.offset, 0) @ net.out + net.bias[0], atol=1e-5)
        assert np.isclose(p[i].sum(), 1)


def toy(n=240):
    """Texts where a word of one of two stems marks the bad ones."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        words = [f"w{rng.integers(60)}" for _ in range(40)]
        if i % 3 == 0:
            words[int(rng.integers(40))] = f"grob{rng.integers(1000)}" if i % 2 else "awful"
        rows.append((int(i % 3 == 0), "de" if i % 2 else "en", " ".join(words)))
    return rows


def test_classifier_learns_words_and_stems():
    rows = toy()
    model = toxicity.Classifier(rows)
    texts = [f"w1 w2 grob{i} w3 w4" for i in range(2000, 2020)] + ["w5 w6 awful. w7"] * 5 + ["w1 w2 w3 w4 w9"] * 20 + [""]
    s = model.score(*common.text_buffer(pa.array(texts)))
    assert (s[:25] >= toxicity.CUT).mean() > 0.9 and (s[25:] < toxicity.CUT).all()


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, None, 1)], "doc_id long, quality int, toxic int")
    docs = documents(spark)
    assert [r.score for r in toxicity.toxicity(docs, labels).collect()] == [0.0] * 12
    model = toxicity.Classifier(toy(60))
    got = toxicity.score(docs, model).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns and toxicity.drop_toxic(docs, labels).count() == 12
    assert toxicity.toxicity(documents(spark, []), labels.limit(0)).count() == 0


def test_boosted_trees_learn_an_interaction():
    x = np.random.default_rng(4).uniform(0, 1, (2000, 3))
    y = (x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)
    model = Boosted(rounds=40).fit(x[:1500], y[:1500])
    assert ((sigmoid(model.margin(x[1500:])) > 0.5) == y[1500:]).mean() > 0.95


def test_samples_are_bounded_and_never_held_out(spark):
    docs = spark.range(3000).select(F_id(), F_text())
    out = common.pick_per_class(docs.where(~common.held_out()), "lang", 16).collect()
    assert len(out) <= 32 and len(set(out)) == len(out)
    import zlib

    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in out)


def F_id():
    from pyspark.sql import functions as F

    return F.col("id").alias("doc_id")


def F_text():
    from pyspark.sql import functions as F

    return F.when(F.col("id") % 50 == 0, "rare").otherwise("usual").alias("lang")


def test_toxicity_of_held_out_rows(spark):
    """Precision and recall on the held-out labelled rows of a table large enough to learn from."""
    import os

    import pytest

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("the test tables are not here")
    truth = spark.read.parquet(f"{folder}/labels.parquet").where("toxic IS NOT NULL").select("doc_id", "toxic")
    got = QUERIES["op4_toxicity"](spark, folder).where("held_out").join(truth, "doc_id").toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    precision, recall = hit / (got.predicted == 1).sum(), hit / (got.toxic == 1).sum()
    print(f"toxicity on {len(got)} held-out rows, {(got.toxic == 1).sum()} toxic: precision {precision:.3f}, recall {recall:.3f}")
    assert precision >= 0.9 and recall >= 0.8


def test_convolution_gradients_equal_differences():
    net = cnn.TextCNN(12, 2, dim=3, filters=2, seed=5)
    rng = np.random.default_rng(2)
    net.offset[:] = rng.normal(0, 0.2, net.offset.shape)  # a window of padding stands at 0, the kink of the rectifier
    docs = [rng.integers(0, 12, (n, 2)) for n in (6, 4, 5)]
    ids, bounds = cnn.padded(np.concatenate(docs), np.cumsum([0, 6, 4, 5]), net.buckets)
    y, lang = np.array([1, 0, 1], np.float32), np.array([0, 1, -1])

    def loss():
        _, _, h, mean = net._forward(ids, bounds[:-1])
        p = 1 / (1 + np.exp(-(np.maximum(h, 0) @ net.out + net.bias)))
        s = mean @ net.lang
        q = np.exp(s - s.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        rows = lang >= 0
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum() / 3 - np.log(q[rows, lang[rows]]).sum() / 3

    for p in net.parameters():  # differences need more digits than the network keeps
        assert p.dtype == np.float32
    for name in ("words", "offset", "out", "bias", "lang"):
        setattr(net, name, getattr(net, name).astype(float))
    net.kernel = [k.astype(float) for k in net.kernel]
    for p, g in zip(net.parameters(), net.step(ids, bounds[:-1], y, lang)):
        for at in list(np.ndindex(p.shape))[::3]:
            if p is net.words and at[0] == net.buckets:
                continue
            old, eps = p[at], 1e-5
            p[at] = old + eps
            up = loss()
            p[at] = old - eps
            down = loss()
            p[at] = old
            assert abs((up - down) / (2 * eps) - g[at]) < 1e-4, at


def test_letters_are_not_number_signs():
    assert all(langid.has_letter(t) for t in ("a", "½ é", "日本", "١ ب"))
    assert not any(langid.has_letter(t) for t in (None, "", "½", "² ① 3", "_ 12", "😀"))
