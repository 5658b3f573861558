"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence scores by the weights of its distinct words and of their first and last letters; a document's score is the noisy-or of its sentences. Only documents
carry labels, and the gradient of the noisy-or shares them out among sentences; afterwards the sentences that score
above the threshold are the offending ones. Null or empty text has no sentence and scores 0. Without both classes
among the usable labels every sentence scores alike. Repeated rows score alike; a null doc_id counts as not held out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import documents_of, map_batches
from wardline.llm.linear import SLOTS, TRAINING_ROWS, Ftrl, fit_once, held_out, sigmoid, training_rows

_TOKEN = re.compile(r"\w+|[.!?\n]")
_SENTENCE = re.compile(r"[^.!?\n]+")
_KEPT = 200_000


class TokenTable(dict):
    """Number of each token seen, with the slots of the word and of its ends; number 0 is what ends a sentence."""

    def __init__(self):
        super().__init__({end: 0 for end in ".!?\n"})
        self.slots = np.zeros((1 << 12, 4), np.int64)
        self.size = 1

    def __missing__(self, token: str) -> int:
        at = self.size
        if at == len(self.slots):
            self.slots = np.concatenate([self.slots, np.zeros_like(self.slots)])
        word = token.strip("_")
        parts = (word, "<" + word[:4], "<" + word[:5], word[-4:] + ">")
        self.slots[at] = [1 + zlib.crc32(part.encode()) % (SLOTS - 1) for part in parts]
        self.size += 1
        self[token] = at
        return at


_TABLE = TokenTable()


def sentences_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the distinct words of each sentence, four a word, and where the sentences begin among them."""
    global _TABLE
    if _TABLE.size > _KEPT:
        _TABLE = TokenTable()
    tokens = _TOKEN.findall(text.lower())
    at = np.fromiter(map(_TABLE.__getitem__, tokens), np.int64, len(tokens))
    word = at > 0
    distinct = np.unique(np.cumsum(~word)[word] * _TABLE.size + at[word])
    sentence = distinct // _TABLE.size
    return _TABLE.slots[distinct % _TABLE.size].ravel(), 4 * np.flatnonzero(np.diff(sentence, prepend=-1))


def _features(text: str) -> dict:
    slots, starts = sentences_of(text)
    distinct, at = np.unique(slots, return_inverse=True)
    return {"slots": distinct.astype(np.int32), "at": at.astype(np.int32), "starts": starts.astype(np.int32)}


def _train(rows: list[tuple[int, dict]], passes: int = 8) -> np.ndarray:
    positive = sum(label for label, _ in rows)
    model = Ftrl(rate=2.0, l1=3.0, l2=1e-3, constant=-5.0)
    constant = np.zeros(1, np.int64)
    if 0 < positive < len(rows):
        for _ in range(passes):
            for label, row in rows:
                starts = row["starts"]
                if not starts.size:
                    continue
                slots = np.concatenate([constant, row["slots"]])
                weights = model.weights(slots)
                p = sigmoid(weights[0] + np.add.reduceat(weights[1:][row["at"]], starts))
                clean = np.exp(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())
                share = p * (-clean / max(1 - clean, 1e-12) if label else 1.0)
                each = np.repeat(share, np.diff(starts, append=row["at"].size))
                gradient = np.concatenate([[share.sum()], np.bincount(row["at"], each, len(row["slots"]))])
                model.update(slots, weights, gradient)
    return model.weights(np.arange(SLOTS))


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> np.ndarray:
    return fit_once(training_rows(docs, labels, "toxic", rows), _features, _train)


def sentence_scores(weights: np.ndarray, text: str) -> np.ndarray:
    slots, starts = sentences_of(text)
    if not starts.size:
        return np.zeros(0)
    return sigmoid(float(weights[0]) + np.add.reduceat(weights[slots].astype(np.float64), starts))


def offending_spans(weights: np.ndarray, text: str, threshold: float) -> list[tuple[int, int, float]]:
    """(start, end, score) in code points of the sentences that score at least ``threshold``, in order."""
    found = []
    for match in _SENTENCE.finditer(text):
        scores = sentence_scores(weights, match.group())
        if scores.size and scores.max() >= threshold:
            found.append((match.start(), match.end(), float(scores.max())))
    return found


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, offending): offending sentences of the documents predicted toxic."""
    weights = fit_toxicity(docs, labels, rows)
    model = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    layout = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("offending", pa.list_(span))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spans = [], []
            for text in batch.column(1).to_pylist():
                each = sentence_scores(model.value, text)
                scores.append(float(-np.expm1(np.log1p(-np.minimum(each, 1 - 1e-12)).sum())))
                spans.append([
                    {"start": a, "end": b, "score": s} for a, b, s in offending_spans(model.value, text, threshold)
                ] if scores[-1] >= threshold else [])
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(span))], schema=layout)

    scored = map_batches(
        documents_of(docs), score, "doc_id long, score double, offending array<struct<start: long, end: long, score: double>>"
    )
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "offending",
    )
