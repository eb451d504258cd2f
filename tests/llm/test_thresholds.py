import numpy as np

from cwlight.llm import common, toxicity
from tests.llm.test_models import toy


def table(n, mark):
    rng = np.random.default_rng(5)
    return [(int(i % 4 == 0), "en", " ".join([f"w{rng.integers(60)}" for _ in range(20)] + [mark] * (i % 4 == 0))) for i in range(n)]


def frames(spark, rows):
    docs = spark.createDataFrame([(i, lang, t) for i, (_, lang, t) in enumerate(rows)], "doc_id long, lang string, text string")
    return docs, spark.createDataFrame([(i, None, v) for i, (v, _, _) in enumerate(rows)], "doc_id long, quality int, toxic int")


def test_all_labelled_rows_that_are_not_held_out_calibrate(spark):
    """Also those beyond the sample, of any length; copies of fitted texts do not."""
    long = "w1 " * toxicity.LEARN_BYTES
    rows = table(400, "awful") + [(0, "de", long + f"w{i}") for i in range(6)]
    docs, labels = frames(spark, rows)
    picked = toxicity.sample(docs, labels, 40)
    model = toxicity.Classifier(picked)
    fitted = {t for i, (_, _, t) in enumerate(picked) if i % 4 != 3}
    free = {r.doc_id for r in docs.where(~common.held_out()).select("doc_id").collect()}
    want = [sum(v == label for i, (v, _, t) in enumerate(rows) if i in free and t not in fitted) for label in (0, 1)]
    counts, weights = toxicity.calibration(docs, labels, model)
    assert counts.sum(axis=(0, 2)).tolist() == want and want[1] > 20
    assert np.allclose(weights * want, [sum(v == label for i, (v, _, _) in enumerate(rows) if i in free) for label in (0, 1)])


def test_each_language_moves_by_its_own_rows_without_a_switch():
    model = toxicity.Classifier(toy())
    counts = np.zeros((2, 2, toxicity.BINS))
    low, high, apart = (int(x) for x in toxicity.bins(np.array([-1.0, 3.0, 6.0])))
    counts[0, 0, low], counts[0, 1, high] = 1000, 1000
    model.calibrate(counts)
    assert model.threshold[0] == model.threshold[1] == 1 + 0.5 / toxicity.FINE
    # Twelve toxic rows of the other language, with harmless ones as high as the first one's toxic rows.
    counts[1, 0, high], counts[1, 1, apart] = 200, 12
    model.calibrate(counts)
    assert model.threshold[0] < 3 < model.threshold[1] < 6
