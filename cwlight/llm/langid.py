"""Language of every document by a bidirectional gated recurrent network over bytes.

Learning: a bounded sample (``PER_CLASS`` documents a language at most, ``CUTS``
segments of ``SPAN`` bytes from each, spread over its whole text) is gathered
and fitted on the driver.  Prediction: a text's bytes are cut into consecutive
segments; the network labels every position of every segment, and a document's
probabilities are the mean over all its positions.  Each byte of a text counts
once, and no context crosses a segment's edge, so a long text needs no more
memory than a short one.

Defined cases: a text that is null or holds no letter (of any script; number
signs such as a half are none) is ``und`` with score 0; with nothing to learn
from, every text is.  A language seen in the sample only can be predicted; of
equally likely ones the first by name is.  Of rows that share a doc_id and a
language one is learned from, that with the least segments; every row is
predicted by its own text.  Columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cwlight.llm.common import cut, held_out, pick_per_class, pieces, small, text_buffer
from cwlight.llm.gru import ByteTagger

PER_CLASS, CUTS, SPAN, HIDDEN = 256, 4, 64, 8
SEGMENT, BLOCK_BYTES = 128, 1 << 18
#: Sampled ids that are broadcast at most.
FEW = 1 << 16
#: Letters and number signs such as a half; ``str.isalpha`` tells them apart.
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return text is not None and any(m[0].isalpha() for m in LETTER.finditer(text))


def sample(docs: DataFrame, per_class: int = PER_CLASS) -> list[tuple[str, bytes]]:
    """(language, bytes) segments to learn from; at most ``per_class * CUTS`` a language."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    ids = cut(pick_per_class(rows, "lang", per_class))
    # With few languages the ids are small enough to go to the texts; else both are shuffled.
    ids = small(ids, FEW)
    body = F.encode("text", "UTF-8")
    room = F.greatest(F.octet_length("text") - SPAN, F.lit(0))
    spread = F.transform(F.sequence(F.lit(0), F.lit(CUTS - 1)), lambda i: F.substring(body, (room * i / F.lit(max(1, CUTS - 1))).cast("int") + 1, F.lit(SPAN)))
    chosen = rows.join(ids, ["lang", "doc_id"]).select("lang", "doc_id", spread.alias("cuts")).groupBy("lang", "doc_id").agg(F.min("cuts").alias("cuts"))
    return [(r["lang"], bytes(c)) for r in sorted(chosen.collect(), key=lambda r: (r["lang"], r["doc_id"])) for c in r["cuts"]]


def learn(segments: list[tuple[str, bytes]], hidden: int = HIDDEN, rounds: int = 250) -> tuple[list[str], ByteTagger | None]:
    """The languages and a fitted network; every language weighs the same."""
    names = sorted({x for x, _ in segments})
    if not names:
        return [], None
    x = np.full((len(segments), SPAN), 32, np.uint8)
    for i, (_, s) in enumerate(segments):
        x[i, : len(s)] = np.frombuffer(s, np.uint8)
    y = np.array([names.index(n) for n, _ in segments])
    most = np.bincount(y).max()
    even = np.concatenate([np.resize(np.flatnonzero(y == k), most) for k in range(len(names))])
    net = ByteTagger(len(names), hidden)
    net.fit(x[even], y[even], rounds)
    return names, net


def pooled(net: ByteTagger, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, classes): the mean probabilities over all bytes of each row."""
    n, total = len(offsets) - 1, None
    size = np.diff(offsets)
    many = -(-size // SEGMENT)
    owner = np.repeat(np.arange(n), many)
    place = (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * SEGMENT
    start, width = offsets[owner] + place, np.minimum(SEGMENT, size[owner] - place)
    step = max(1, BLOCK_BYTES // SEGMENT)
    for a in range(0, len(owner), step):
        s, w = start[a : a + step], width[a : a + step]
        at = s[:, None] + np.arange(SEGMENT)
        inside = np.arange(SEGMENT) < w[:, None]
        x = np.where(inside, raw[np.minimum(at, len(raw) - 1)], 32).astype(np.uint8)
        p = (net.probabilities(x) * inside.T[:, :, None]).sum(axis=0)
        if total is None:
            total = np.zeros((n, p.shape[1]))
        np.add.at(total, owner[a : a + step], p)
    if total is None:
        return np.zeros((n, len(net.bias)))
    return total / np.maximum(size, 1)[:, None]


def predict(docs: DataFrame, names: list[str], net: ByteTagger | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``."""

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column(2))
            label, score = [], []
            texts = batch.column(2)
            for a, b in pieces(offsets, 4 << 20):
                worded = [has_letter(t) for t in texts.slice(a, b - a).to_pylist()]
                p = pooled(net, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) if net else np.zeros((b - a, 1))
                best = p.argmax(axis=1)
                label += [names[k] if w and net else "und" for w, k in zip(worded, best)]
                score += [float(x[k]) if w and net else 0.0 for w, k, x in zip(worded, best, p)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(label, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def languages(docs: DataFrame) -> DataFrame:
    """Learns from the rows that are not held out, then predicts all rows."""
    return predict(docs, *learn(sample(docs)))
