"""Sequences, fitted encoders and splits on the given tables.

Users are entities and their events the steps. Minutes are counted back from a fixed end.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suite.registry import Tables, query, rounded
from wardline.functions import scalars, vectors
from wardline.operators import embedding, fits, scoring, sequences, split
from wardline.plans import training
from wardline.session import scratch_path

END = "2024-02-01 00:00:00"
_STEPS_SQL = f"""SELECT user_id, event_id, event_type, props, value, CASE WHEN event_id % 17 <> 0
  THEN date_sub('minute', ts, TIMESTAMP '{END}') END AS minutes FROM events"""
_POSITIONS_SQL = f"""SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY minutes DESC NULLS LAST, event_id) - 1 AS pos FROM ({_STEPS_SQL})"""
TIES = ["event_id"]


def steps(t: Tables) -> DataFrame:
    """Event rows with minutes to the end; some have no time."""
    minutes = scalars.minutes_between(F.col("ts"), F.lit(END).cast("timestamp_ntz"))
    return t.events.select(
        "user_id", "event_id", "event_type", "props", "value", F.when(F.col("event_id") % 17 != 0, minutes).alias("minutes")
    )


def order():
    return sequences.timeline_order("minutes", TIES)


def sort_values():
    return sequences.timeline_sort_values("minutes", TIES)


@query("timeline_sort", f"SELECT user_id, event_id, minutes, pos FROM ({_POSITIONS_SQL})")
def timeline_sort(t: Tables) -> DataFrame:
    return sequences.timeline_sort(steps(t).select("user_id", "event_id", "minutes"), "user_id", "minutes", TIES)


@query("position_index", """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, md5(text)) - 1 AS pos FROM conversations""")
def position_index(t: Tables) -> DataFrame:
    turns = t.conversations.select("conv_id", "turn", "role", F.md5("text").alias("digest"))
    return sequences.position_index(turns, "conv_id", [F.col("turn"), F.col("role"), F.col("digest")]).drop("role", "digest")


@query("head_k_per_entity", f"SELECT user_id, event_id, pos FROM ({_POSITIONS_SQL}) WHERE pos < 20")
def head_k_per_entity(t: Tables) -> DataFrame:
    return sequences.head_k_per_entity(steps(t), "user_id", order(), 20).select("user_id", "event_id", "pos")


@query("last_k_per_entity", f"""SELECT user_id, event_id, pos FROM (SELECT user_id, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY minutes NULLS LAST, event_id) - 1 AS pos FROM ({_STEPS_SQL})) WHERE pos < 20""")
def last_k_per_entity(t: Tables) -> DataFrame:
    latest = [F.col("minutes").asc_nulls_last(), F.col("event_id")]
    return sequences.head_k_per_entity(steps(t), "user_id", order(), 20, "last", latest).select("user_id", "event_id", "pos")


@query("sequence_per_entity", f"SELECT user_id, pos, event_type, props, minutes FROM ({_POSITIONS_SQL})")
def sequence_per_entity(t: Tables) -> DataFrame:
    arrays = sequences.sequence_per_entity(steps(t), "user_id", ["event_type", "props", "minutes"], "minutes", TIES)
    rows = arrays.select("user_id", "first_pos", F.posexplode("steps").alias("at", "s"))
    return rows.select("user_id", (F.col("first_pos") + F.col("at")).alias("pos"), "s.event_type", "s.props", "s.minutes")


@query("first_row_per_entity", f"SELECT user_id, event_id, event_type, value FROM ({_POSITIONS_SQL}) WHERE pos = 0")
def first_row_per_entity(t: Tables) -> DataFrame:
    return sequences.first_row_per_entity(steps(t), "user_id", ["event_id", "event_type", "value"], sort_values())


@query("fit_categories", "SELECT row_number() OVER (ORDER BY c)::int - 1 AS slot, c AS category FROM (SELECT DISTINCT coalesce(nullif(event_type, 'error'), 'Unknown') AS c FROM events)")
def fit_categories(t: Tables) -> DataFrame:
    df = t.events.select(F.nullif("event_type", F.lit("error")).alias("kind"))
    return fits.fit_categories(fits.fit(df, ["kind"], impute=fits.UNKNOWN), "kind")


@query("fit_scaler", f"SELECT round(avg(minutes), 5) AS mean, round(stddev_pop(minutes), 5) AS deviation FROM ({_STEPS_SQL})")
def fit_scaler(t: Tables) -> DataFrame:
    fit = fits.fit_scaler(fits.fit(steps(t), numbers=["minutes"]), "minutes")
    return fit.select(rounded(F.col("mean"), 5).alias("mean"), rounded(F.col("deviation"), 5).alias("deviation"))


@query("cohort_summary", """SELECT count(*) AS entities, sum(label)::bigint AS positives, round(avg(label), 6) AS positive_rate, round(avg(n), 6) AS mean_length
  FROM (SELECT user_id, count(*) AS n, max(CASE WHEN pos = 0 AND value > 50 THEN 1 ELSE 0 END) AS label FROM (""" + _POSITIONS_SQL + ") GROUP BY user_id)")
def cohort_summary(t: Tables) -> DataFrame:
    summary = sequences.cohort_summary(steps(t), "user_id", F.when(F.col("value") > 50, 1).otherwise(0), sort_values())
    return summary.withColumns({c: rounded(F.col(c)) for c in ("positive_rate", "mean_length")})


@query("max_sequence_length", "SELECT max(n) AS max_length FROM (SELECT count(*) AS n FROM events GROUP BY user_id)")
def max_sequence_length(t: Tables) -> DataFrame:
    return sequences.max_sequence_length(t.events, "user_id")


_EMB_SQL = "SELECT vec_id, label, unnest(embedding)::double AS x, generate_subscripts(embedding, 1)::int - 1 AS i FROM embeddings"


@query("sequence_mean_pool", f"SELECT label, i AS dim, round(avg(x), 5) AS value FROM ({_EMB_SQL}) GROUP BY label, i")
def sequence_mean_pool(t: Tables) -> DataFrame:
    pooled = sequences.sequence_mean_pool(t.embeddings, "label", "embedding")
    return pooled.select("label", F.posexplode("pooled").alias("dim", "v")).select("label", "dim", rounded(F.col("v"), 5).alias("value"))


# ---- encoders ----

_TYPES_SQL = "SELECT c, row_number() OVER (ORDER BY c)::int - 1 AS slot FROM (SELECT DISTINCT event_type AS c FROM events)"


@query("one_hot_event_type", f"""SELECT event_id, slot, CASE WHEN event_type = c THEN 1.0::double ELSE 0.0::double END AS value
  FROM events, ({_TYPES_SQL})""")
def one_hot_event_type(t: Tables) -> DataFrame:
    code = fits.one_hot_column(fits.fit(t.events, ["event_type"]), "event_type")
    return t.events.select("event_id", F.posexplode(code).alias("slot", "value"))


_CUSTOMER_SQL = """SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'Unknown') AS segment, coalesce(n_name, 'Unknown') AS nation,
  CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey"""
_FILLED_SQL = f"WITH c AS ({_CUSTOMER_SQL}), f AS (SELECT *, coalesce(balance, (SELECT avg(balance) FROM c)) AS filled FROM c)"
_HOT_SQL = """SELECT c_custkey, slot, CASE WHEN segment = k THEN 1.0::double ELSE 0.0::double END AS value FROM c,
    (SELECT k, row_number() OVER (ORDER BY k)::int - 1 AS slot FROM (SELECT DISTINCT segment AS k FROM c))
  UNION ALL SELECT c_custkey, slot + (SELECT count(DISTINCT segment)::int FROM c), CASE WHEN nation = k THEN 1.0::double ELSE 0.0::double END FROM c,
    (SELECT k, row_number() OVER (ORDER BY k)::int - 1 AS slot FROM (SELECT DISTINCT nation AS k FROM c))"""


def people(t: Tables) -> DataFrame:
    nations = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    return t.customer.join(nations, "c_nationkey", "left").select(
        "c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), "nation",
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"),
    )


@query("category_slots", f"""SELECT c_custkey, slot FROM (WITH c AS ({_CUSTOMER_SQL}) SELECT c_custkey, k.slot FROM c LEFT JOIN
    (SELECT n, row_number() OVER (ORDER BY n)::int - 1 AS slot FROM (SELECT DISTINCT n_name AS n FROM nation JOIN customer ON c_nationkey = n_nationkey)) k ON k.n = c.nation)""")
def category_slots(t: Tables) -> DataFrame:
    df = people(t)
    return fits.slots(df, fits.fit(df, ["nation"]), "nation", "slot").select("c_custkey", "slot")


@query("one_hot_static", f"WITH c AS ({_CUSTOMER_SQL}) {_HOT_SQL}")
def one_hot_static(t: Tables) -> DataFrame:
    df = people(t)
    return df.select("c_custkey", F.posexplode(fits.static_vector(fits.fit(df, ["segment", "nation"], impute=fits.UNKNOWN), ["segment", "nation"], None)).alias("slot", "value"))


_BALANCE_SQL = "(filled - (SELECT avg(filled) FROM f)) / (SELECT stddev_pop(filled) FROM f)"


@query("static_vector", f"""{_FILLED_SQL} SELECT c_custkey, slot, round(value, 6) AS value FROM ({_HOT_SQL}
  UNION ALL SELECT c_custkey, (SELECT (count(DISTINCT segment) + count(DISTINCT nation))::int FROM c), {_BALANCE_SQL} FROM f)""")
def static_vector(t: Tables) -> DataFrame:
    df = people(t)
    fitted = fits.fit(df, ["segment", "nation"], ["balance"], fits.UNKNOWN)
    vector = fits.static_vector(fitted, ["segment", "nation"], "balance")
    return df.select("c_custkey", F.posexplode(vector).alias("slot", "v")).select("c_custkey", "slot", rounded(F.col("v")).alias("value"))


@query("scale_numeric", f"{_FILLED_SQL} SELECT c_custkey, round({_BALANCE_SQL}, 6) AS scaled FROM f")
def scale_numeric(t: Tables) -> DataFrame:
    df = people(t)
    return df.select("c_custkey", rounded(fits.scaled_column(fits.fit(df, numbers=["balance"]), "balance", mean_fill=True)).alias("scaled"))


_SCALED_SQL = f"""SELECT event_id, user_id, event_type, (minutes - (SELECT avg(minutes) FROM ({_STEPS_SQL}))) /
  (SELECT stddev_pop(minutes) FROM ({_STEPS_SQL})) AS z FROM ({_STEPS_SQL})"""


@query("scale_time", f"SELECT event_id, round(z, 6) AS scaled FROM ({_SCALED_SQL})")
def scale_time(t: Tables) -> DataFrame:
    df = steps(t)
    return df.select("event_id", rounded(fits.scaled_column(fits.fit(df, numbers=["minutes"]), "minutes")).alias("scaled"))


@query("time_sinusoid", f"""SELECT event_id, i::int AS slot, round(CASE WHEN i % 2 = 0 THEN sin(z / pow(10000::double, i / 16::double))
  ELSE cos(z / pow(10000::double, i / 16::double)) END, 5) AS value FROM ({_SCALED_SQL}), range(16) r(i)""")
def time_sinusoid(t: Tables) -> DataFrame:
    df = steps(t)
    code = vectors.time_waves(fits.scaled_column(fits.fit(df, numbers=["minutes"]), "minutes"), 16)
    return df.select("event_id", F.posexplode(code).alias("slot", "v")).select("event_id", "slot", rounded(F.col("v"), 5).alias("value"))


@query("position_encoding", f"""SELECT pos, i::int AS slot, round(CASE WHEN i % 2 = 0 THEN sin(pos * exp((i - i % 2) * (-ln(10000::double) / 256)))
  ELSE cos(pos * exp((i - i % 2) * (-ln(10000::double) / 256))) END, 4) AS value FROM (SELECT DISTINCT pos FROM ({_POSITIONS_SQL})), range(256) r(i)""")
def position_encoding(t: Tables) -> DataFrame:
    placed = sequences.position_index(steps(t).select("user_id", "event_id", "minutes"), "user_id", order()).select("pos").distinct()
    code = vectors.position_waves(F.col("pos"), 256)
    return placed.select("pos", F.posexplode(code).alias("slot", "v")).select("pos", "slot", rounded(F.col("v"), 4).alias("value"))


@query("timestep_vector", f"""WITH z AS ({_SCALED_SQL}), k AS ({_TYPES_SQL}), n AS (SELECT count(*)::int AS types FROM k)
  SELECT event_id, slot, CASE WHEN event_type = c THEN 1.0::double ELSE 0.0::double END AS value FROM z, k
  UNION ALL SELECT event_id, types + i, round(x, 4) FROM z JOIN ({_EMB_SQL}) ON vec_id = event_id, n
  UNION ALL SELECT event_id, (types + i)::int, 0.0::double FROM z, n, range(64) r(i) WHERE event_id NOT IN (SELECT vec_id FROM embeddings)
  UNION ALL SELECT event_id, types + 64, round(z::float::double, 4) FROM z, n""")
def timestep_vector(t: Tables) -> DataFrame:
    df = steps(t)
    found = df.join(t.embeddings.select(F.col("vec_id").alias("event_id"), "embedding"), "event_id", "left")
    text = F.coalesce(F.col("embedding").cast("array<double>"), F.array_repeat(F.lit(0.0), 64))
    vector = training.step_vector(training.fit_features(df, [], None, time="minutes"), text, time="minutes")
    rows = found.select("event_id", F.posexplode(vector).alias("slot", "v"))
    return rows.select("event_id", "slot", rounded(F.col("v").cast("double"), 4).alias("value"))


# ---- the training set, end to end ----

_FLAT_SQL = f"""SELECT user_id, event_id AS icu_stay_id, event_type, props AS event_text, minutes, coalesce(segment, 'Unknown') AS segment,
  coalesce(nation, 'Unknown') AS nation, balance, (value > 50)::int AS expired FROM ({_STEPS_SQL}) LEFT JOIN ({_CUSTOMER_SQL}) ON c_custkey = user_id"""
_FLAT_POSITIONS_SQL = """SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY minutes DESC NULLS LAST, event_type NULLS FIRST, event_text NULLS FIRST,
  icu_stay_id NULLS FIRST) - 1 AS pos FROM flat"""


def text_shape(texts: list[str]) -> np.ndarray:
    """A tiny encoder that SQL can repeat: characters and ones of a text."""
    return np.array([[len(text), text.count("1")] for text in texts], dtype=np.float32)


def training_set(t: Tables) -> training.TrainingSet:
    """All events of all users; half of the texts are in the cache before."""
    customers = people(t).withColumnRenamed("c_custkey", "user_id")
    flat = steps(t).join(customers, "user_id", "left").select(
        "user_id", F.col("event_id").alias("icu_stay_id"), "event_type", F.col("props").alias("event_text"),
        F.col("minutes").alias(sequences.RELATIVE_TIME), "segment", "nation", "balance", (F.col("value") > 50).cast("int").alias(training.LABEL),
    )
    path = scratch_path(t.spark, "text-cache")
    embedding.embed_text(t.spark, flat.where("icu_stay_id % 2 = 0"), "event_text", path, text_shape)
    return training.prepare_training_set(flat, path, 2, text_shape, "user_id", static=["segment", "nation"], number="balance")


@query("training_steps", f"""WITH flat AS ({_FLAT_SQL}), p AS ({_FLAT_POSITIONS_SQL}), k AS ({_TYPES_SQL}), n AS (SELECT count(*)::int AS types FROM k)
  SELECT user_id, pos, slot, (event_type = c)::int::double AS value FROM p, k
  UNION ALL SELECT user_id, pos, types, length(event_text)::double FROM p, n
  UNION ALL SELECT user_id, pos, types + 1, (length(event_text) - length(replace(event_text, '1', '')))::double FROM p, n
  UNION ALL SELECT user_id, pos, types + 2, round(((minutes - (SELECT avg(minutes) FROM flat)) / (SELECT stddev_pop(minutes) FROM flat))::float::double, 4) FROM p, n""")
def training_steps(t: Tables) -> DataFrame:
    rows = training_set(t).sequences.select("user_id", "first_pos", F.posexplode("steps").alias("at", "step"))
    placed = rows.select("user_id", (F.col("first_pos") + F.col("at")).alias("pos"), F.posexplode("step").alias("slot", "v"))
    return placed.select("user_id", "pos", "slot", rounded(F.col("v").cast("double"), 4).alias("value"))


@query("training_entities", f"""WITH flat AS ({_FLAT_SQL}), c AS (SELECT * FROM ({_FLAT_POSITIONS_SQL}) WHERE pos = 0),
  s AS (SELECT DISTINCT segment AS k FROM flat), na AS (SELECT DISTINCT nation AS k FROM flat), m AS (SELECT avg(balance) AS mean FROM flat),
  f AS (SELECT coalesce(balance, mean) AS b FROM flat, m), e AS (
    SELECT user_id, expired AS label, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY expired) AS n FROM c
    WINDOW w AS (PARTITION BY expired ORDER BY md5('42:' || user_id::varchar), user_id)),
  x AS (SELECT user_id, label, place, n, floor(n * 0.2::double + 0.5) AS n_test FROM e),
  split AS (SELECT user_id, label, CASE WHEN place < n_test THEN 'test' WHEN place < n_test + floor((n - n_test) * 0.2::double + 0.5) THEN 'validation'
    ELSE 'train' END AS split FROM x),
  v AS (SELECT user_id, slot, (segment = k)::int::double AS value FROM c, (SELECT k, row_number() OVER (ORDER BY k)::int - 1 AS slot FROM s)
    UNION ALL SELECT user_id, slot + (SELECT count(*)::int FROM s), (nation = k)::int::double FROM c, (SELECT k, row_number() OVER (ORDER BY k)::int - 1 AS slot FROM na)
    UNION ALL SELECT user_id, (SELECT count(*)::int FROM s) + (SELECT count(*)::int FROM na), round((coalesce(balance, mean) - (SELECT avg(b) FROM f)) / (SELECT stddev_pop(b) FROM f), 6) FROM c, m)
  SELECT user_id, slot, value, label, split FROM v JOIN split USING (user_id)""")
def training_entities(t: Tables) -> DataFrame:
    rows = training_set(t).entities.select("user_id", F.posexplode("static").alias("slot", "v"), "label", "split")
    return rows.select("user_id", "slot", rounded(F.col("v")).alias("value"), "label", "split")


# ---- truncation, padding, masks ----


@query("truncate_sequence", """SELECT doc_id, pos, word FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word,
  generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents) WHERE pos < 100""")
def truncate_sequence(t: Tables) -> DataFrame:
    words = t.documents.select("doc_id", vectors.truncate(F.split("text", " "), 100).alias("words"))
    return words.select("doc_id", F.posexplode("words").alias("pos", "word")).withColumn("pos", F.col("pos").cast("long"))


_PADDED_SQL = f"""WITH s AS (SELECT user_id, event_id, pos FROM ({_POSITIONS_SQL})),
  u AS (SELECT user_id, user_id % 4 AS batch, max(pos) + 1 AS n FROM s GROUP BY user_id),
  m AS (SELECT batch, max(n) AS longest FROM u GROUP BY batch),
  w AS (SELECT user_id, n, unnest(range(longest)) AS pos FROM u JOIN m USING (batch))
  SELECT w.user_id, w.pos, coalesce(event_id, 0)::double AS value, w.pos < n AS real FROM w LEFT JOIN s ON s.user_id = w.user_id AND s.pos = w.pos"""


def _padded(t: Tables) -> DataFrame:
    """Whole sequences of event numbers, padded to the longest of four batches of users."""
    placed = sequences.position_index(steps(t).select("user_id", "event_id", "minutes"), "user_id", order())
    batched = placed.select((F.col("user_id") % 4).alias("batch"), "user_id", "pos", F.col("event_id").cast("double").alias("value"))
    return sequences.pad_steps(batched, "batch", "user_id", {"value": F.lit(0.0)})


@query("pad_sequence", f"SELECT user_id, pos, value FROM ({_PADDED_SQL})")
def pad_sequence(t: Tables) -> DataFrame:
    return _padded(t).select("user_id", "pos", "value")


@query("padding_mask", f"SELECT user_id, pos, real FROM ({_PADDED_SQL})")
def padding_mask(t: Tables) -> DataFrame:
    return _padded(t).select("user_id", "pos", "real")


# ---- split ----

_SPLIT_SQL = """SELECT doc_id, quality, CASE WHEN place < n_test THEN 'test' WHEN place < n_test + floor((n - n_test) * 0.2::double + 0.5) THEN 'validation'
  ELSE 'train' END AS split FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id::varchar), doc_id) - 1 AS place,
  count(*) OVER (PARTITION BY quality) AS n, floor(count(*) OVER (PARTITION BY quality) * 0.2::double + 0.5) AS n_test FROM labels)"""


def split_labels(t: Tables) -> DataFrame:
    return split.stratified_split(t.labels.select("doc_id", "quality"), "doc_id", "quality")


@query("stratified_split", _SPLIT_SQL)
def stratified_split(t: Tables) -> DataFrame:
    return split_labels(t)


@query("dataset_by_split", f"""SELECT split, count(*) AS n, sum(n_chars)::bigint AS chars, sum(quality)::bigint AS positives FROM ({_SPLIT_SQL})
  JOIN documents USING (doc_id) GROUP BY split""")
def dataset_by_split(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "datasets")
    split.write_datasets(split_labels(t).join(t.documents.select("doc_id", "n_chars"), "doc_id"), path)
    rows = t.spark.read.parquet(path)  # a dataset is read by its folder
    summed = [
        split.dataset_of(rows, name).groupBy("split").agg(
            F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.sum("quality").alias("positives")
        )
        for name in ("train", "validation", "test")
    ]
    return reduce(DataFrame.unionByName, summed)


@query("feature_dims", f"""WITH c AS ({_CUSTOMER_SQL}) SELECT ((SELECT count(DISTINCT event_type) FROM events) + 768 + 1)::int AS input_dim,
  ((SELECT count(DISTINCT segment) + count(DISTINCT nation) FROM c) + 1)::int AS static_dim""")
def feature_dims(t: Tables) -> DataFrame:
    flat = t.events.select(F.col("user_id").alias("c_custkey"), "event_type").join(people(t), "c_custkey", "full")
    fitted = training.fit_features(flat, ["segment", "nation"], "balance", time="c_custkey")
    return training.feature_dims(fitted, 768, 1, ["segment", "nation"], 1)


@query("running_best", """SELECT user_id, event_id, value, coalesce(value < min(value) OVER (PARTITION BY user_id ORDER BY event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM events""")
def running_best(t: Tables) -> DataFrame:
    return scoring.running_best(t.events.select("user_id", "event_id", "value"), "user_id", "event_id", "value")


@query("best_epoch", """SELECT user_id, arg_min(event_id, (value, event_id)) AS best_epoch, min(value) AS best_loss FROM events GROUP BY user_id""")
def best_epoch(t: Tables) -> DataFrame:
    return scoring.best_epoch(t.events.select("user_id", "event_id", "value"), "user_id", "event_id", "value")


