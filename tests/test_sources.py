"""Round trips through files and the vector cache."""

import os
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline import session
from wardline.operators import embedding
from wardline.sources import tables, vector_cache
from wardline.sources.schemas import FLAT_EVENTS, STATIC_CATEGORIES, STATIC_NUMBER

TEXTS = ['plain', 'line\nbreak', 'said "so", twice ""', "trailing tab\t", "  both  ", "", None, "ünïcode é", 'ends with quote"', "\\back\\", "a\r\nb", "c\rd"]


@pytest.fixture()
def flat(spark):
    rows = [
        (i, datetime(2150, 1, 1, 0, 0, i, 5), "labevent", text, None if i == 2 else i * 10 - 30, i % 2, *["x"] * len(STATIC_CATEGORIES),
         None if i == 1 else 50.5 + i)
        for i, text in enumerate(TEXTS)
    ]
    return spark.createDataFrame(rows, FLAT_EVENTS)


def test_csv_keeps_line_breaks_quotes_and_null(spark, flat, tmp_path):
    path = str(tmp_path / "flat")
    tables.write_csv_shards(flat, path, 3)
    assert len([f for f in os.listdir(path) if f.endswith(".csv")]) == 3
    back = tables.scan_csv(spark, path, FLAT_EVENTS)
    assert back.schema.simpleString() == flat.schema.simpleString()
    found = {r.patient_id: r for r in back.collect()}
    assert len(found) == len(TEXTS)
    for row in flat.collect():
        ours = found[row.patient_id]
        assert ours[STATIC_NUMBER] == row[STATIC_NUMBER] and ours.event_time == row.event_time
        assert ours.event_text == (row.event_text or None)  # empty text reads as NULL


def test_missing_words_read_as_null(spark, tmp_path):
    (tmp_path / "words.csv").write_text("id,word,n\n1,None,2.5\n2,some,NaN\n3,NA,\n")
    rows = tables.scan_csv(spark, str(tmp_path / "words.csv"), "id int, word string, n double").collect()
    assert [r.word for r in sorted(rows)] == [None, "some", None]
    assert [r.word for r in tables.scan_csv(spark, str(tmp_path / "words.csv"), "id int, word string, n double", missing=()).collect()][0] == "None"


def test_shared_folder_is_the_named_one(spark, tmp_path):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or session.shared_dir(spark) == named.rstrip("/")
    assert session.scratch_path(spark, "a") != session.scratch_path(spark, "a")


def test_parquet_shards_and_inspection(spark, flat, tmp_path):
    path = str(tmp_path / "shards")
    flat.repartition(4).write.parquet(path)
    back = tables.scan_parquet_shards(spark, path)
    columns, rows = tables.inspect_table(back, 3)
    assert columns == flat.columns and rows.count() == 3 and back.count() == len(TEXTS)


def test_attention_sink_writes_a_folder_per_epoch(spark, tmp_path):
    path = str(tmp_path / "attention")
    rows = [(e, 0, h, p, 0.25) for e in range(3) for h in range(2) for p in range(4)]
    weights = spark.createDataFrame(rows, "epoch int, batch int, head int, pos int, weight double")
    tables.attention_sink(weights.where("epoch < 2"), path)
    tables.attention_sink(weights.where("epoch = 2"), path)
    assert sorted(f for f in os.listdir(path) if f.startswith("epoch")) == ["epoch=0", "epoch=1", "epoch=2"]
    plan = spark.read.parquet(path).where("epoch = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(epoch" in plan


def test_missing_cache_is_empty_and_corrupt_files_are_skipped(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert vector_cache.vector_cache_scan(spark, path).count() == 0
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "text_md5 string, embedding array<float>")
    vector_cache.vector_cache_append(vectors, path)
    (tmp_path / "cache" / "broken.parquet").write_bytes(b"not a parquet file")
    assert {r.text_md5: list(r.embedding) for r in vector_cache.vector_cache_scan(spark, path).collect()} == {"a": [1.0, 2.0], "b": [3.0, 4.0]}


def test_a_key_stored_twice_does_not_multiply_rows(spark, tmp_path):
    path = str(tmp_path / "cache")
    vectors = spark.createDataFrame([("x",)], "t string").select(F.md5("t").alias("text_md5"), F.array(F.lit(1.0)).alias("embedding"))
    vector_cache.vector_cache_append(vectors, path)
    vector_cache.vector_cache_append(vectors, path)
    rows = spark.createDataFrame([("x",), ("y",)], "t string")
    found = vector_cache.vector_cache_lookup(rows, "t", vector_cache.vector_cache_scan(spark, path)).collect()
    assert len(found) == 2 and {r.t: r.embedding is None for r in found} == {"x": False, "y": True}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bucketed_cache_is_not_shuffled(spark, tables, tmp_path, no_broadcast):
    path = str(tmp_path / "it's a cache")
    texts = tables.documents.select("doc_id", "text")
    vectors = texts.where("doc_id % 3 > 0").select(F.md5("text").alias("text_md5"), F.array(F.col("doc_id").cast("float")).alias("embedding"))
    assert vector_cache.vector_cache_create(spark, path, 5) == 5
    vector_cache.vector_cache_append(vectors, path)
    cache = vector_cache.vector_cache_scan(spark, path)
    keys = vector_cache.distinct_keys(texts, "text")
    misses = vector_cache.vector_cache_misses(keys, cache, 5)
    looked = vector_cache.vector_cache_lookup(texts, "text", cache, 5)
    semi = cache.join(keys.repartition(5, "text_md5"), "text_md5", "left_semi")
    for df, moves in ((misses, 2), (looked, 1), (semi, 2)):  # distinct keys move once for themselves
        assert "Bucketed: true" in _plan(df) and _plan(df).count("Exchange") == moves
    plain = vector_cache.vector_cache_lookup(texts, "text", vectors.dropDuplicates(["text_md5"]))
    assert sorted(r.doc_id for r in looked.where("embedding is null").collect()) == sorted(r.doc_id for r in plain.where("embedding is null").collect())
    assert looked.count() == texts.count()
    known = {r.text_md5 for r in cache.collect()}
    assert {r.text_md5 for r in misses.collect()} == {r.text_md5 for r in keys.collect()} - known


def test_appending_known_keys_writes_no_file(spark, tmp_path):
    path = str(tmp_path / "cache")
    vectors = spark.range(100).select(F.md5(F.col("id").cast("string")).alias("text_md5"), F.array(F.col("id").cast("float")).alias("embedding"))
    vector_cache.vector_cache_append(vectors, path)
    files = sorted(os.listdir(path))
    vector_cache.vector_cache_append(vectors, path)
    assert sorted(os.listdir(path)) == files
    more = spark.range(90, 110).select(F.md5(F.col("id").cast("string")).alias("text_md5"), F.array(F.lit(-1.0)).alias("embedding"))
    vector_cache.vector_cache_append(more.unionAll(more), path)
    found = [list(r.embedding)[0] for r in vector_cache.vector_cache_scan(spark, path).collect()]
    assert sorted(found) == [-1.0] * 10 + [float(i) for i in range(100)]


def test_another_application_reads_the_buckets(spark, tmp_path):
    path = str(tmp_path / "cache")
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "text_md5 string, embedding array<float>")
    vector_cache.vector_cache_append(vectors, path)
    other = spark.newSession()
    vector_cache.vector_cache_append(other.createDataFrame([("c", [3.0])], vectors.schema), path)
    assert sorted(r.text_md5 for r in vector_cache.vector_cache_scan(spark, path).collect()) == ["a", "b", "c"]


def test_frequent_texts_stay_in_place(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.range(400).select("id", F.when(F.col("id") < 300, "hot").otherwise(F.col("id").cast("string")).alias("t"))
    rows = rows.unionAll(spark.createDataFrame([(400, None)], "id long, t string"))
    vectors = spark.createDataFrame([("hot",), ("399",), ("",)], "t string").select(F.md5("t").alias("text_md5"), F.array(F.lit(1.0)).alias("embedding"))
    vector_cache.vector_cache_append(vectors, path)
    cache, buckets = vector_cache.vector_cache_scan(spark, path), vector_cache.vector_cache_buckets(spark, path)
    found = vector_cache.vector_cache_lookup(rows, "t", cache, buckets)
    assert "BroadcastHashJoin" in _plan(found)
    got = {r.id: r.embedding for r in found.collect()}
    assert len(got) == 401 and [i for i in got if got[i] is not None] and sorted(i for i in got if got[i]) == [*range(300), 399, 400]


def test_plain_folder_of_vectors_stays_plain(spark, tmp_path):
    path = str(tmp_path / "cache")
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "text_md5 string, embedding array<float>")
    vectors.where("text_md5 = 'a'").write.parquet(path)
    vector_cache.vector_cache_append(vectors, path)
    assert vector_cache.vector_cache_create(spark, path) is None
    assert sorted(r.text_md5 for r in vector_cache.vector_cache_scan(spark, path).collect()) == ["a", "b"]


def test_second_run_encodes_nothing(spark, tmp_path):
    path = str(tmp_path / "cache")
    calls = spark.sparkContext.accumulator(0)

    def encoder(texts):
        calls.add(len(texts))
        assert len(texts) <= embedding.BATCH
        return np.array([[len(t), 1.0] for t in texts])

    docs = spark.createDataFrame([("one",), ("two words",), ("one",), (None,), ("",)], "t string")
    first = {r.text_md5: list(r.embedding) for r in embedding.embed_text(spark, docs, "t", path, encoder).collect()}
    assert calls.value == 3 and len(first) == 3
    more = docs.unionAll(spark.createDataFrame([("new",)], "t string"))
    second = embedding.embed_text(spark, more, "t", path, encoder)
    assert calls.value == 4 and second.count() == 4
    # only the vectors of the asked texts come back
    assert embedding.embed_text(spark, more.where("t = 'new'"), "t", path, encoder).count() == 1
    embedding.embed_text(spark, more, "t", path, encoder)
    assert calls.value == 4


def test_default_vectors_have_fixed_width_and_length_one(spark, tables, tmp_path):
    cache = embedding.embed_text(spark, tables.documents, "text", str(tmp_path / "cache"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = cache.select(F.size("embedding").alias("width"), norm.alias("norm")).collect()
    assert {r.width for r in rows} == {embedding.WIDTH}
    assert all(abs(r.norm - 1) < 1e-5 for r in rows)
    empty = embedding.hashed_word_vectors(vector_cache.distinct_texts(spark.createDataFrame([("",), (" .,",)], "t string"), "t"))
    assert [sum(r.embedding) for r in empty.collect()] == [0.0, 0.0] and all(len(r.embedding) == 768 for r in empty.collect())


def test_projection_is_linear_and_repeatable(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 2.0]), (2, [0.0, 0.0, 0.0])], "id int, v array<float>")
    rows = {r.id: np.array(r.projected) for r in embedding.project_vector(df, "v", 3, 5).collect()}
    matrix = embedding.projection_matrix(3, 5)
    assert np.allclose(rows[1], matrix[0] + 2 * matrix[2]) and not rows[2].any()


def test_a_second_run_of_an_epoch_takes_the_place_of_the_first(spark, tmp_path):
    path = str(tmp_path / "attention")
    weights = spark.range(60).selectExpr("cast(id % 3 as int) as epoch", "cast(id % 2 as int) as batch", "id", "id / 7.0D as weight")
    for part in (weights, weights.where("epoch = 1"), weights.where("epoch = 2 and batch = 0"), weights):
        tables.attention_sink(part, path)
    back = spark.read.parquet(path)
    assert sorted(map(tuple, back.select(weights.columns).collect())) == sorted(map(tuple, weights.collect()))
    tables.attention_sink(weights.where("epoch = 1 and batch = 1").limit(2), path)
    counts = {(r.epoch, r.batch): r["count"] for r in spark.read.parquet(path).groupBy("epoch", "batch").count().collect()}
    assert counts == {(e, b): 2 if (e, b) == (1, 1) else 10 for e in range(3) for b in range(2)}


def test_default_vectors_are_made_where_the_texts_are_read(spark, tables):
    texts = vector_cache.keyed_texts(tables.documents, "text")
    plan = embedding.hashed_word_vectors(texts)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_token_cut(spark, tmp_path):
    docs = spark.createDataFrame([("  one two  three four",), ("one two",), ("",), (" \n ",), (None,), ("one two",)], "t string")
    cut = embedding.embed_text(spark, docs, "t", str(tmp_path / "cut"), max_tokens=2)
    whole = embedding.embed_text(spark, spark.createDataFrame([("one two",)], "t string"), "t", str(tmp_path / "whole")).first()
    assert cut.count() == 4
    assert sorted(sum(map(bool, r.embedding)) for r in cut.collect()) == [0, 0, 2, 2]
    assert [list(r.embedding) for r in cut.collect() if any(r.embedding)] == [list(whole.embedding)] * 2

    def lengths(texts):
        return [[len(text.split()), len(texts), max(len(t.split()) for t in texts)] for text in texts]

    many = spark.createDataFrame([("w " * n + f"x{k}",) for k, n in enumerate([1, 50, 2, 49, 3, 200, 1, 2])], "t string").coalesce(1)
    rows = embedding.embed_text(spark, many, "t", str(tmp_path / "many"), lengths, budget=110).collect()
    assert sorted(r.embedding[0] for r in rows) == [2, 2, 3, 3, 4, 50, 51, 201]
    assert all(r.embedding[1] * r.embedding[2] <= 110 or r.embedding[1] == 1 for r in rows)
    short = embedding.embed_text(spark, many, "t", str(tmp_path / "short"), lengths, max_tokens=10).collect()
    assert max(r.embedding[0] for r in short) == 10
