"""Quality classifier: hashed word n-gram logistic regression, learnt by follow-the-regularised-leader updates.

A word is what white space separates. Its unigrams are its letters and its form (case and signs), its bigrams those of
neighbouring words; a word that follows itself has a slot of its own. Values are shares of the words of a text, a score
is a sparse dot product. Null or empty text has the constant alone. With no usable label, or one class only, the score
is the smoothed share of label 1. Repeated rows score alike; a null doc_id counts as not held out.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import bound_batches, free_name
from wardline.llm.linear import SLOTS, TRAINING_ROWS, Ftrl, fit_once, held_out, mix, sigmoid, training_rows

_SIGNS = re.compile(r"[^\W_]+")
_KEPT = 200_000


class WordTable(dict):
    """Number of each word seen, with the slots of its letters and its form."""

    def __init__(self):
        super().__init__()
        self.letters, self.form = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.letters):
            self.letters, self.form = np.resize(self.letters, 2 * at), np.resize(self.form, 2 * at)
        letters = "".join(_SIGNS.findall(word)).lower()
        case = "U" if len(letters) > 1 and word.isupper() else "T" if word[0].isupper() else "l"
        self.letters[at] = 1 + zlib.crc32(b"w" + letters.encode()) % (SLOTS - 1)
        self.form[at] = 1 + zlib.crc32((case + _SIGNS.sub("w", word)[:64]).encode()) % (SLOTS - 1)
        self[word] = at
        return at


_TABLE = WordTable()


def slots_of(text: str) -> np.ndarray:
    """Slots of all n-grams of ``text``, four for each word but the last."""
    global _TABLE
    if len(_TABLE) > _KEPT:
        _TABLE = WordTable()
    words = text.split()
    at = np.fromiter(map(_TABLE.__getitem__, words), np.int64, len(words))
    letters, form = _TABLE.letters[at], _TABLE.form[at]
    again = letters[1:] == letters[:-1]
    return np.concatenate([
        letters, form, np.where(again, 1, mix(letters[1:], letters[:-1])), mix(form[1:] + SLOTS, form[:-1]),
    ])


def _features(text: str) -> dict:
    slots, counts = np.unique(slots_of(text), return_counts=True)
    values = counts / max(1, counts.sum() / 4)
    return {"slots": np.concatenate([[0], slots]).astype(np.int32), "values": np.concatenate([[1.0], values]).astype(np.float32)}


def _train(rows: list[tuple[int, dict]], passes: int = 4) -> np.ndarray:
    positive = sum(label for label, _ in rows)
    rate = (positive + 1) / (len(rows) + 2)
    model = Ftrl(rate=2.0, l1=1e-3, l2=1e-3, constant=float(np.log(rate / (1 - rate))))
    if 0 < positive < len(rows):
        for _ in range(passes):
            for label, row in rows:
                slots, values = row["slots"], row["values"]
                weights = model.weights(slots)
                model.update(slots, weights, (sigmoid(weights @ values) - label) * values)
    return model.weights(np.arange(SLOTS))


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> np.ndarray:
    return fit_once(training_rows(docs, labels, "quality", rows), _features, _train)


def quality_score(docs: DataFrame, weights: np.ndarray, text: Column) -> Column:
    """The probability of label 1 for each whole text, as a column of ``docs``."""
    bound_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        w = model.value
        scores = []
        for text in texts.to_pylist():
            slots = slots_of(text)
            scores.append(float(sigmoid(float(w[0]) + 4 * float(w[slots].sum(dtype=np.float64)) / max(4, len(slots)))))
        return pa.array(scores, pa.float64())

    return score(F.coalesce(text.cast("string"), F.lit("")))


def score_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = docs.select(
        F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
        quality_score(docs, fit_quality(docs, labels, rows), F.col("text")).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(docs: DataFrame, corpus: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold`` by a model learnt from the labelled rows of ``corpus``."""
    score = free_name(docs, "quality_score")
    scored = docs.withColumn(score, quality_score(docs, fit_quality(corpus, labels, rows), F.col("text")))
    return scored.where(F.col(score) >= threshold).select(docs.columns)
