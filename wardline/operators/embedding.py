"""Text vectors: hashed words on Spark, or any encoder that maps a batch of texts to vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from wardline.session import stored
from wardline.sources import vector_cache as cache

# Fixed values
WIDTH = 768
BATCH = 32
#: Words whose slots a task remembers; further ones are hashed again, which changes no result.
KNOWN_WORDS = 200_000

Encoder = Callable[[list[str]], np.ndarray]


def cut_tokens(text: Column, max_tokens: int | None) -> Column:
    """The first ``max_tokens`` tokens, told apart by white space; the whole text without a limit."""
    if max_tokens is None:
        return text
    tokens = F.split(F.regexp_replace(text, r"^[ \t\n\f\r]+", ""), r"[ \t\n\f\r]+", max_tokens + 1)
    return F.array_join(F.slice(tokens, 1, max_tokens), " ")


def hashed_word_vectors(texts: DataFrame, width: int = WIDTH, max_tokens: int | None = None) -> DataFrame:
    """Default encoder: ``(text_md5, part, embedding)``, signed hashed word counts of the whole text, scaled to length 1.

    Words are split by Spark and counted into one array of fixed width per text, in the task that reads the text: nothing
    is shuffled. A task encodes a text once, ``part`` is its number; texts of several tasks are left for the caller.
    """
    words = F.split(F.lower(cut_tokens(F.col("text"), max_tokens)), r"[^\p{L}\p{N}]+")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {"": 0}
        done: set[str] = set()
        part = TaskContext.get().partitionId()

        def code(word: str) -> int:
            """Twice the slot, one more for a negative sign, after 0 for no word."""
            value = known.get(word)
            if value is None:
                digest = hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()
                value = 2 + 2 * (int(digest[:8], 16) % width) + (digest[8] >= "8")
                if len(known) < KNOWN_WORDS:
                    known[word] = value
            return value

        for batch in batches:
            keys, vectors = [], []
            for key, of_text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key in done:
                    continue
                done.add(key)
                found = of_text.as_py()
                codes = np.fromiter(map(code, found), np.int64, len(found))
                codes = codes[codes > 0] - 2
                counted = np.bincount(codes // 2, 1.0 - 2.0 * (codes % 2), width)
                length = np.sqrt((counted * counted).sum())
                keys.append(key)
                vectors.append((counted / length if length else counted).astype(np.float32))
            flat = np.concatenate(vectors) if vectors else np.zeros(0, np.float32)
            ends = pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32))
            yield pa.record_batch([
                pa.array(keys, pa.string()), pa.array([part] * len(keys), pa.int32()), pa.ListArray.from_arrays(ends, pa.array(flat)),
            ], names=["text_md5", "part", "embedding"])

    return texts.select("text_md5", words.alias("words")).mapInArrow(encode, "text_md5 string, part int, embedding array<float>")


def encoded_vectors(
    texts: DataFrame, encoder: Encoder, batch: int = BATCH, max_tokens: int | None = None, budget: int | None = None
) -> DataFrame:
    """Vectors of any encoder, called with up to ``batch`` texts at a time inside the tasks.

    With ``budget`` texts of similar length go together: the tokens of a call, all texts padded to its longest, stay within
    it, unless one text alone is longer.
    """

    def calls(lengths: list[int]) -> Iterator[list[int]]:
        order = range(len(lengths)) if budget is None else sorted(range(len(lengths)), key=lengths.__getitem__)
        some: list[int] = []
        for i in order:
            if some and (len(some) == batch or (budget is not None and (len(some) + 1) * lengths[i] > budget)):
                yield some
                some = []
            some.append(i)
        if some:
            yield some

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            words = frame["text"].tolist()
            vectors: list = [None] * len(words)
            for some in calls([len(text.split()) for text in words]):
                for i, vector in zip(some, np.asarray(encoder([words[i] for i in some]), dtype=np.float32)):
                    vectors[i] = vector
            yield pd.DataFrame({"text_md5": frame["text_md5"], "embedding": vectors})

    return texts.select("text_md5", cut_tokens(F.col("text"), max_tokens).alias("text")).mapInPandas(encode, cache.CACHE_SCHEMA)


def embed_text(
    spark: SparkSession, df: DataFrame, text: str, cache_path: str, encoder: Encoder | None = None,
    max_tokens: int | None = None, budget: int | None = None,
) -> DataFrame:
    """Encode the texts that the cache lacks, store them, and return the vectors of the texts of ``df``.

    Only keys are compared; the texts of missing keys alone are read, so a second run reads none. The default encoder
    works where the texts are read, once a task; a given one gets each distinct text once. Texts are encoded whole unless
    ``max_tokens`` cuts them; use one cache for one such limit, as the key is that of the whole text.
    """
    buckets = cache.vector_cache_create(spark, cache_path)
    keys = stored(cache.distinct_keys(df, text), "keys")
    known = cache.vector_cache_scan(spark, cache_path)
    first_run = known.isEmpty()
    missing = keys if first_run else stored(cache.vector_cache_misses(keys, known, buckets), "missing")
    if not missing.isEmpty():
        if encoder is None:
            fresh = _encoded_where_read(cache.keyed_texts(df, text), None if first_run else missing, max_tokens)
        else:
            fresh = encoded_vectors(cache.texts_of(df, text, missing), encoder, max_tokens=max_tokens, budget=budget)
        cache.vector_cache_append(fresh, cache_path)
    asked = keys if buckets is None else keys.repartition(buckets, "text_md5")
    return cache.vector_cache_scan(spark, cache_path).join(asked, "text_md5", "left_semi")


def _encoded_where_read(texts: DataFrame, missing: DataFrame | None, max_tokens: int | None) -> DataFrame:
    """``(text_md5, embedding)``, each key once; of the tasks that encoded a text the first counts."""
    wanted = texts if missing is None else texts.join(missing, "text_md5", "left_semi")
    made = stored(hashed_word_vectors(wanted, max_tokens=max_tokens), "made")
    first = made.groupBy("text_md5").agg(F.min("part").alias("part"), F.count(F.lit(1)).alias("parts"))
    again = stored(first.where("parts > 1").select("text_md5", F.col("part").alias("first")), "again")
    return made.join(again, "text_md5", "left").where("first is null or part = first").select("text_md5", "embedding")


def projection_matrix(rows: int, columns: int, seed: int = 42) -> np.ndarray:
    """Random signs scaled by ``1 / sqrt(columns)``; the sign is a digest bit of (seed, row, column)."""
    signs = [
        [1.0 if hashlib.md5(f"{seed}:{r}:{c}".encode()).hexdigest()[0] < "8" else -1.0 for c in range(columns)]
        for r in range(rows)
    ]
    return np.array(signs) / np.sqrt(columns)


def project_vector(df: DataFrame, vector: str, width: int, target: int = 64, seed: int = 42, name: str = "projected") -> DataFrame:
    """Reduce vectors of ``width`` to ``target`` slots with a fixed random projection; no vector stays NULL."""
    matrix = projection_matrix(width, target, seed)

    @F.pandas_udf(ArrayType(DoubleType()))
    def project(batch: pd.Series) -> pd.Series:
        if batch.empty:
            return pd.Series([], dtype=object)
        there = [i for i, vector in enumerate(batch) if vector is not None]
        projected: list = [None] * len(batch)
        if there:
            moved = np.stack([batch.iloc[i] for i in there]).astype(np.float64) @ matrix
            for i, vector in zip(there, moved):
                projected[i] = vector
        return pd.Series(projected, dtype=object)

    return df.withColumn(name, project(F.col(vector)))
