"""Exact dedup by content-defined chunk recipes, with DataFrame functions only.

A normalised text is cut where its content says so; the recipe of a document is the ordered list of its chunks'
identifiers. An identifier is a 64-bit hash that has been verified: distinct chunks are brought together once, bytes
and all, and an identifier under which two different chunks are found is contested. Documents are then compared by
recipe alone, so a long text never moves again; recipes with a contested identifier are told apart by the SHA-256
of the text as well.

Null text counts as empty, and the empty text is a text like any other. Of equal texts the row with the largest
doc_id stays; a null doc_id is smaller than every other. Rows that share the largest doc_id all count as kept.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import documents_of, free_name, stored, without

#: A chunk has at least 256 characters and ends at white space before a letter from a to m, after 2,048 at the latest.
CHUNK = r"(?s).{256,2048}?[ \n](?=[a-m])|.{1,2048}"


def normalised(text: Column) -> Column:
    """A-Z lower-cased, nothing else changed."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def chunks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def recipes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, recipe) with hashes that are not verified yet."""
    texts = documents_of(docs).select("doc_id", normalised(F.col("text")).alias("text"))
    return texts.select(
        "doc_id",
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        F.transform(chunks_of(F.col("text")), lambda chunk: F.xxhash64(chunk)).alias("recipe"),
    )


def contested_hashes(docs: DataFrame) -> DataFrame:
    """Hashes under which the distinct chunks, compared byte by byte, are more than one."""
    texts = documents_of(docs).select(normalised(F.col("text")).alias("text"))
    chunks = texts.select(F.explode(chunks_of(F.col("text"))).alias("chunk"))
    distinct = chunks.select(F.xxhash64("chunk").alias("hash"), "chunk").distinct()
    return distinct.groupBy("hash").agg(F.count("*").alias("chunks")).where("chunks > 1").select("hash")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per document."""
    made = stored(recipes(docs), "recipes")
    contested = stored(contested_hashes(docs), "contested")
    if contested.isEmpty():
        keyed = made.withColumn("told_apart", F.lit(None).cast("string"))
    else:
        parts = made.select("text_sha256", F.explode("recipe").alias("hash")).join(contested, "hash")
        unsure = parts.select("text_sha256", F.col("text_sha256").alias("told_apart")).distinct()
        keyed = made.join(unsure, "text_sha256", "left")
    groups = keyed.groupBy("recipe", "told_apart").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # joined on a key of fixed width, then on the lists themselves
    key = F.xxhash64("recipe", "told_apart")
    groups = groups.select(
        key.alias("key"), F.col("recipe").alias("of"), F.col("told_apart").alias("of_apart"), "keep_id", "group_size"
    )
    keyed = keyed.withColumn("own_key", key)
    same = (F.col("own_key") == F.col("key")) & (F.col("recipe") == F.col("of")) & F.col("told_apart").eqNullSafe(F.col("of_apart"))
    return keyed.join(groups, same).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def text_key(text: Column) -> Column:
    """Tells texts apart as exact dedup does."""
    return F.xxhash64(F.sha2(normalised(F.coalesce(text.cast("string"), F.lit(""))).cast("binary"), 256))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, one with the largest doc_id; rows without doc_id stay.

    Other texts under a doc_id that goes stay. Where several rows share that largest doc_id and its text any one of them
    stays; only such rows are brought together, and a row for each is chosen before they are shuffled.
    """
    found = stored(exact_duplicates(docs).where("doc_id is not null").select("doc_id", "kept", F.xxhash64("text_sha256").alias("text_key")), "found")
    left = without(docs, found.where(~F.col("kept")).select("doc_id", "text_key"), text_key(docs["text"]))
    again = found.where("kept").groupBy("doc_id", "text_key").count().where("count > 1").select(
        F.col("doc_id").alias("again_id"), F.col("text_key").alias("again_text")
    )
    again = stored(again, "again")
    if again.isEmpty():
        return left
    same = (left["doc_id"] == again["again_id"]) & (text_key(left["text"]) == again["again_text"])
    key = free_name(left, "text_key")
    once = left.join(again, same, "left_semi").withColumn(key, text_key(F.col("text"))).dropDuplicates(["doc_id", key]).drop(key)
    return left.join(again, same, "left_anti").unionByName(once)
