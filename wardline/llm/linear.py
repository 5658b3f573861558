"""What the trained scorers share: labelled training rows, follow-the-regularised-leader, fitting in one bounded task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import documents_of, map_batches

#: Slots of hashed features; slot 0 is the constant. A model is this many 4-byte numbers, whatever the input.
SLOTS = 1 << 18
#: The fit uses about this many labelled rows, chosen by a hash of doc_id.
TRAINING_ROWS = 8_192


def held_out(doc_id: Column) -> Column:
    """The rows no label is learnt from; false where there is no id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, text, label): labelled documents outside the held-out rows, about ``rows`` of them.

    Ids are chosen by a hash of doc_id. An id with both labels teaches nothing; equal rows count once. Where chosen ids
    have many texts, so that there are more than twice as many rows, texts are chosen by a hash as well.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    usable = usable.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("high")).where("label = high").drop("high")
    total = usable.count()
    share = min(1.0, rows / max(total, 1))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))
    found = documents_of(docs).join(chosen, "doc_id")
    if docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(chosen, "doc_id").count() <= min(total, 2 * rows):
        return found.dropDuplicates(["doc_id", "text"])
    found = found.withColumn("text_key", F.xxhash64("doc_id", "text"))
    texts = found.select("doc_id", "text_key").distinct().count()
    share = min(1.0, 2 * rows / max(texts, 1))
    kept = found.where(F.pmod(F.xxhash64("text_key", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))
    return kept.dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text", "label")


def fit_once(
    rows: DataFrame, features: Callable[[str], dict], train: Callable[[list[tuple[int, dict]]], np.ndarray]
) -> np.ndarray:
    """Features are made where the texts are; the bounded sample meets in one task, which returns the weights."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pickle.dumps(features(text)) for text in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.binary()), batch.column(2)], names=["doc_id", "made", "label"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [
            (doc_id, made, label)
            for batch in batches
            for doc_id, made, label in zip(*(column.to_pylist() for column in batch.columns))
        ]
        found.sort(key=lambda row: (row[0] * 2_654_435_761 % 2**32, row[0], row[1]))
        weights = train([(label, pickle.loads(made)) for _, made, label in found])
        yield pa.record_batch([pa.array([weights.astype("<f4").tobytes()], pa.binary())], names=["weights"])

    made = map_batches(rows.select("doc_id", "text", "label"), prepare, "doc_id long, made binary, label int")
    model = map_batches(made.repartition(1), learn, "weights binary").collect()  # one row of SLOTS numbers
    return np.frombuffer(model[0]["weights"], "<f4").astype(np.float64) if model else np.zeros(SLOTS)


def mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Slots of pairs."""
    h = (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (1 + (h >> np.uint64(32)) % np.uint64(SLOTS - 1)).astype(np.int64)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Ftrl:
    """Follow the regularised leader, a rate of its own for each slot; the constant is not drawn to zero."""

    def __init__(self, rate: float, l1: float, l2: float, beta: float = 1.0, constant: float = 0.0):
        self.rate, self.l1, self.l2, self.beta, self.constant = rate, l1, l2, beta, constant
        self.sums, self.squares = np.zeros(SLOTS), np.zeros(SLOTS)

    def weights(self, slots: np.ndarray) -> np.ndarray:
        sums = self.sums[slots]
        l1 = np.where(slots == 0, 0.0, self.l1)
        shrunk = np.sign(sums) * l1 - sums
        weights = np.where(np.abs(sums) <= l1, 0.0, shrunk / ((self.beta + np.sqrt(self.squares[slots])) / self.rate + self.l2))
        return weights + np.where(slots == 0, self.constant, 0.0)

    def update(self, slots: np.ndarray, weights: np.ndarray, gradient: np.ndarray) -> None:
        """``slots`` are distinct, ``weights`` what weights() returned for them."""
        old = self.squares[slots]
        new = old + gradient * gradient
        self.sums[slots] += gradient - (np.sqrt(new) - np.sqrt(old)) / self.rate * (weights - np.where(slots == 0, self.constant, 0.0))
        self.squares[slots] = new
