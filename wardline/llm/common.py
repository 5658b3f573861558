"""Helpers shared by the text operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.session import stored  # noqa: F401


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = 2_000, size: str = "16m") -> None:
    """Batches between Spark and Python are bounded by rows and bytes, so very long texts do not pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    # workers of a local session find the package where the driver has it; clusters get it with --py-files or installed
    here = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if here not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([here, *filter(None, paths)])


def map_batches(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` with bounded batches."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def documents_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Only (doc_id, text), null text as empty: columns beside them cannot clash with anything computed here."""
    return docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"),
    )


#: Ids to leave out are sent to the documents up to this number (16 bytes each at most); more are joined by a shuffle.
MOST_SENT = 2_000_000


def without(docs: DataFrame, ids: DataFrame, text_key: Column | None = None) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids``; rows without doc_id stay.

    With ``text_key``, an expression over ``docs``, only those that have the ``text_key`` of ``ids`` as well.
    """
    keys = [F.col("doc_id").alias("gone")] + ([] if text_key is None else [F.col("text_key").alias("gone_text")])
    ids = stored(ids.where(F.col("doc_id").isNotNull()).select(*keys).distinct(), "gone")
    few = ids.count() <= MOST_SENT
    same = docs["doc_id"] == ids["gone"]
    if text_key is not None:
        same &= text_key == ids["gone_text"]
    return docs.join(F.broadcast(ids) if few else ids, same, "left_anti")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so in any case."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
