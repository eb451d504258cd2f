"""Toxic documents by a convolutional text classifier.

Learning: a bounded sample of labelled rows (``PER_CLASS`` of each label at most,
of up to ``LEARN_BYTES`` bytes each) is gathered and three quarters of it are
fitted on the driver.  A word is hashed to two buckets, its
own and that of its first ``STEM`` letters; buckets seen in fewer than ``SEEN``
sampled texts share one.

Calibration: every labelled row that is neither held out nor a copy of a fitted
text is scored, whatever its length and however many there are; all that comes
back is a count for each predicted language, label and score bin.  For each
language the threshold parts these labels best.  All languages together stand
beside each language as ``PRIOR`` toxic rows, so a language with few toxic rows
moves from the common threshold by what its rows say, and none by a switch.  A
text's own threshold
is the mean of these, weighted by the language probabilities that the model
reads from the text, and its score is moved so that 0.7 stands there.

Prediction: every word of every text is convolved; texts go through in pieces
of about ``PIECE`` bytes.

Defined cases: a doc_id labelled both ways counts as toxic; of rows that share a
doc_id the one with the least text (then language) is learned from, and every
row is scored by its own text; null and empty texts get the score of a text without words; with
no label of one kind in the sample every score is 0.  Columns other than
doc_id, text and lang are ignored.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cwlight.llm.cnn import TextCNN
from cwlight.llm.common import held_out, pick_per_class, pieces, text_buffer
from cwlight.llm.wordhash import stems, words

PER_CLASS, LEARN_BYTES, BUCKETS, SEEN, PIECE = 1024, 16_384, 1 << 16, 3, 1 << 20
STEM = 4
CUT = 0.7
#: Score bins of 1 / FINE each, from -SPAN to SPAN, and the toxic rows that all languages count for in each.
FINE, SPAN, PRIOR = 32, 64, 20
BINS = 2 * SPAN * FINE


def word_ids(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of each word, row bounds); ASCII letters in lower case, signs part words."""
    raw = raw + (((raw >= 65) & (raw <= 90)).astype(np.uint8) << np.uint8(5))
    h, starts, ends, bounds = words(raw, offsets, plain=True)
    both = np.stack([h, stems(raw, starts, ends, STEM)], axis=1)
    return (both >> np.uint64(40)).astype(np.int64) % BUCKETS, bounds


def known(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic), one row for each labelled document."""
    return labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> list[tuple[int, str, str]]:
    """(label, language, text) of at most ``per_class`` rows of each label."""
    fit = F.octet_length("text") <= LEARN_BYTES
    rows = docs.where(~held_out() & (F.length("text") > 0) & fit).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    ids = pick_per_class(rows.select("doc_id").join(known(labels), "doc_id"), "toxic", per_class)
    # Two labels: at most 2 * per_class ids, so that the texts need not be shuffled for them.
    least = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("m"))
    chosen = least.select("doc_id", "toxic", "m.text", "m.lang").collect()
    return [(r["toxic"], r["lang"], r["text"]) for r in sorted(chosen, key=lambda r: r["doc_id"])]


def bins(z: np.ndarray) -> np.ndarray:
    return np.clip(((z + SPAN) * FINE).astype(np.int64), 0, BINS - 1)


def mark(text) -> bytes:
    """A digest of the bytes of a text."""
    return blake2b(text, digest_size=16).digest()


def best_cut(counts: np.ndarray) -> float:
    """The middle of the gap that gives the best F-measure, precision counting twice, from weights (label, score bin)."""
    at = np.flatnonzero(counts.sum(axis=0))[::-1]
    hits, taken = np.cumsum(counts[1, at]), np.cumsum(counts[:, at].sum(axis=0))
    k = int((1.25 * hits / (taken + 0.25 * hits[-1])).argmax())
    return float((at[k] + at[min(k + 1, len(at) - 1)] + 1) / 2 / FINE - SPAN)


class Classifier:
    """A fitted network, its languages and their thresholds."""

    def __init__(self, rows: list[tuple[int, str, str]]) -> None:
        raw, offsets = text_buffer(pa.array([t for _, _, t in rows], pa.string()))
        ids, bounds = word_ids(raw, offsets)
        docs = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        y = np.array([v for v, _, _ in rows])
        names = sorted({n for _, n, _ in rows if n is not None})
        lang = np.array([names.index(n) if n is not None else -1 for _, n, _ in rows])
        apart = np.arange(len(rows)) % 4 == 3
        # Repeats of one text would pass for evidence: words count once per distinct text.
        own = np.zeros(len(rows), bool)
        own[[i for _, i in {t: i for i, (_, _, t) in reversed(list(enumerate(rows))) if not apart[i]}.items()]] = True
        seen, bad = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for i in np.flatnonzero(own):
            u = np.unique(docs[i])
            seen[u] += 1
            bad[u] += y[i]
        share = y[own].mean()
        odds = np.log((bad + share) / (seen - bad + 1 - share)) - np.log(share / (1 - share))
        keep = seen >= SEEN
        size = int(keep.sum())
        self.rename = np.full(BUCKETS, size)
        self.rename[keep] = np.arange(size)
        docs = [self.rename[d] for d in docs]
        self.net = TextCNN(size, len(names))
        # Words seen in few texts say little, however one-sided they are.
        self.net.warm((np.clip(odds, -1, 3) * seen / (seen + 10))[keep].astype(np.float32))
        train = np.flatnonzero(own)
        self.net.fit([docs[i] for i in train], y[train], lang[train])
        self.tables = self.net.tables().astype(np.float32)
        self.fitted = {mark(rows[i][2].encode()) for i in train}
        z, p = self._margins(docs)
        guess = p.argmax(axis=1)
        self.threshold = np.zeros(max(1, len(names)))
        whole, part = (np.zeros((len(self.threshold), 2, BINS)) for _ in range(2))
        np.add.at(whole, (guess, y, bins(z)), 1)
        np.add.at(part, (guess[apart], y[apart], bins(z[apart])), 1)
        # Until the table's counts come, the rows kept apart decide; where these lack a label, the fitted ones too.
        self.calibrate(part if part.sum(axis=(0, 2)).all() else whole)

    def calibrate(self, counts: np.ndarray, weights: tuple[float, float] = (1.0, 1.0)) -> None:
        """Sets the thresholds from counts (language, label, score bin) and what a row of each label stands for."""
        if counts.sum(axis=(0, 2)).all():
            own = counts * np.array(weights)[None, :, None]
            prior = own.sum(axis=0) * (PRIOR / counts[:, 1].sum())
            self.threshold = np.array([best_cut(x + prior) for x in own])

    def placed(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(predicted language, score bin) of each text, before any threshold."""
        ids, bounds = word_ids(raw, offsets)
        z, p = self.net.scores(self.tables, self.rename[ids], bounds)
        return p.argmax(axis=1), bins(z)

    def _margins(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return self.net.scores(self.tables, np.concatenate([*docs, np.zeros((0, 2), np.int64)]), np.cumsum([0, *map(len, docs)]))

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        ids, bounds = word_ids(raw, offsets)
        z, p = self.net.scores(self.tables, self.rename[ids], bounds)
        x = z - p @ self.threshold + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def calibration(docs: DataFrame, labels: DataFrame, model: Classifier) -> tuple[np.ndarray, np.ndarray]:
    """Counts (language, label, score bin) of all labelled rows that are not held out, without copies of fitted texts.

    Fitting takes a larger share of one label than of the other, so beside them
    stands how many rows of its label each counted row stands for.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            guess, at, own = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for a, b in pieces(offsets, PIECE):
                g, z = shared.value.placed(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                guess.append(g)
                at.append(z)
                own += [mark(raw[offsets[i] : offsets[i + 1]]) in shared.value.fitted for i in range(a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(x), pa.int32()) for x in (guess, at)), pa.array(own, pa.bool_())], names=["doc_id", "guess", "at", "fitted"])

    # Labels join the scores, not the texts, so that no text is shuffled.
    rows = docs.where(~held_out() & (F.length("text") > 0)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, guess int, at int, fitted boolean").join(known(labels), "doc_id")
    counts, whole = np.zeros((len(model.threshold), 2, BINS)), np.zeros(2)
    for r in scored.groupBy("guess", "toxic", "at", "fitted").agg(F.count(F.lit(1)).alias("n")).collect():
        whole[r["toxic"]] += r["n"]
        if not r["fitted"]:
            counts[r["guess"], r["toxic"], r["at"]] += r["n"]
    return counts, whole / np.maximum(1, counts.sum(axis=(0, 2)))


def learn(docs: DataFrame, labels: DataFrame) -> Classifier | None:
    rows = sample(docs, labels)
    if len({v for v, _, _ in rows}) < 2:
        return None
    model = Classifier(rows)
    model.calibrate(*calibration(docs, labels, model))
    model.fitted = set()
    return model


def score(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column(2))
            out = [np.zeros(0)]
            for a, b in pieces(offsets, PIECE):
                out.append(shared.value.score(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) if shared.value else np.zeros(b - a))
            s = np.concatenate(out).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic; each row is judged by its own text."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column("text"))
            keep = [np.zeros(0, bool)]
            for a, b in pieces(offsets, PIECE):
                keep.append(shared.value.score(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) < CUT if shared.value else np.ones(b - a, bool))
            yield batch.filter(pa.array(np.concatenate(keep)))

    rows = docs.withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(run, rows.schema)
