"""SentencePiece ids of whole texts, each distinct marked word segmented once.

Where no piece of the model holds a whitespace marker behind another
character, no piece crosses the start of a marked word, so a text's ids are
those of its words, one after the other.  Each task keeps a table from a marked
word to its ids and its decoded text; a text is cut at the markers, unknown
words are segmented together by the library, and ids are joined back by
position.  The table has two halves of ``TABLE / 2`` words: when the young one is
full it becomes the old one, and words of the old one that come again move to
the young.  So what recurs stays, however many rare words pass by, and is
segmented once in a task.  (A table of all words made by Spark would shuffle each
word of each text with its place, some six times the input.)

A model with pieces across markers, or with a normaliser that does more than
marking blanks, is run on whole texts.

Defined cases: a null text counts as empty, and an empty one has the end id
only; a text of any length is encoded whole, and one with more distinct words
than half a table holds its own words besides; repeated rows and ids, also null
ones, each give a row; an empty table gives no rows.  Columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
TABLE = 200_000
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def splits_at_marks(path: str) -> bool:
    """Whether words of this model can be segmented apart: see the module's text."""
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(_model(path).serialized_model_proto())
    plain = spec.normalizer_spec
    return (
        spec.trainer_spec.model_type == 2
        and not plain.precompiled_charsmap
        and plain.add_dummy_prefix
        and plain.escape_whitespaces
        and not plain.remove_extra_whitespaces
        and not spec.trainer_spec.treat_whitespace_as_suffix
        and all(p.type != 4 and MARK not in p.piece.lstrip(MARK) for p in spec.pieces)
    )


class Encoder:
    """Ids and decoded text of texts, by a table of marked words."""

    def __init__(self, path: str) -> None:
        self.model = _model(path)
        self.by_word = splits_at_marks(path)
        self.lone = (str(self.model.piece_to_id(MARK)), 1, " ")  # no input of the library gives a marker alone
        self.table: dict[str, tuple[str, int, str]] = {}
        self.old: dict[str, tuple[str, int, str]] = {}
        self.segmented = 0
        # A decoded text loses its dummy blank; behind any other piece nothing is lost.
        self.lead = self.model.encode("a")
        self.lead_text = self.model.decode(self.lead)

    def _learn(self, words: list[str]) -> None:
        self.segmented += len(words)
        # The library puts a marker before each input: words start with one, which is taken off.
        ids = self.model.encode([w[1:] for w in words], num_threads=1)
        texts = self.model.decode([self.lead + x for x in ids], num_threads=1)
        cut = len(self.lead_text)
        for w, x, t in zip(words, ids, texts):
            self.table[w] = (" ".join(map(str, x)), len(x), t[cut:]) if w != MARK else self.lone

    def run(self, text: str) -> tuple[str, int, str]:
        """(decimal ids joined by one space, number of ids, decoded text); the end id comes last."""
        end = self.model.eos_id()
        if not self.by_word or not text:
            ids = self.model.encode(text) + [end]
            return " ".join(map(str, ids)), len(ids), self.model.decode(ids)
        words = WORD.findall(MARK + text.replace(" ", MARK))
        table, old, new = self.table, self.old, []
        for w in dict.fromkeys(words):
            if w not in table:
                known = old.get(w)
                if known is None:
                    new.append(w)
                else:
                    table[w] = known
        if new:
            self._learn(new)
        found = [table[w] for w in words]
        if len(table) > TABLE // 2:
            self.old, self.table = table, {}
        decoded = "".join([x[2] for x in found])
        return " ".join([x[0] for x in found] + [str(end)]), sum([x[1] for x in found]) + 1, decoded[1:]


def encode_decode(docs: DataFrame, model_path: str, with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids][, decoded]) of every row of ``docs``.

    ``model_path`` must name the same file on every worker.
    """

    def run(batches):
        encoder = Encoder(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n, sha, back, ids, decoded = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    x, k, t = encoder.run(text or "")
                    n.append(k)
                    sha.append(hashlib.sha256(x.encode()).hexdigest())
                    back.append(hashlib.sha256(t.encode()).hexdigest())
                    if with_ids:
                        ids.append(np.fromstring(x, np.int32, sep=" "))
                    if with_text:
                        decoded.append(t)
                columns = {"doc_id": part.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(sha, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
                if with_ids:
                    columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
                if with_text:
                    columns["decoded"] = pa.array(decoded, pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
