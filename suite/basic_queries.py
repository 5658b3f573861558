"""Sources, projections, joins and scalar functions on the given tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suite.registry import Tables, query, rounded
from wardline.functions import scalars, text, vectors
from wardline.operators import cohort, embedding, fits, ordered, sequences, split
from wardline.session import scratch_path
from wardline.sources import tables, vector_cache

# the declared schemas; money is declared as decimal and keys as long, so the scan has something to bring into shape
SCHEMAS = {
    "region": "r_regionkey bigint, r_name string",
    "nation": "n_nationkey bigint, n_name string, n_regionkey bigint",
    "customer": "c_custkey bigint, c_name string, c_nationkey bigint, c_acctbal decimal(12,2), c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey bigint, s_acctbal decimal(12,2)",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice decimal(12,2)",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice decimal(12,2), o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber bigint, l_quantity double, l_extendedprice decimal(12,2), "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label bigint",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
EVENTS_DDL = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"

# ---- sources and sinks ----


def _first_columns(ddl: str) -> tuple[str, str]:
    """The first column, and the first column of text."""
    columns = [c.strip().split(" ") for c in re.split(r",(?![0-9])", ddl)]
    return columns[0][0], next((name for name, kind in columns if kind == "string"), columns[0][0])


@query("scan_tables", " UNION ALL ".join(
    f"""SELECT '{n}' AS table_name, count(*) AS n_rows, {len(re.split(r",(?![0-9])", ddl))} AS n_columns, '{ddl.replace(", ", ",")}' AS columns,
    sum({_first_columns(ddl)[0]})::bigint AS keys, count(DISTINCT {_first_columns(ddl)[1]}) AS texts FROM {n}""" for n, ddl in SCHEMAS.items()))
def scan_tables(t: Tables) -> DataFrame:
    def summary(name: str, df: DataFrame) -> DataFrame:
        key, text_column = _first_columns(SCHEMAS[name])
        return df.agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"),
            F.lit(",".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)).alias("columns"),
            F.sum(key).alias("keys"), F.countDistinct(text_column).alias("texts"),
        )

    found = tables.scan_tables(t.spark, t.root, SCHEMAS, SCHEMAS)
    return reduce(DataFrame.unionByName, [summary(n, df) for n, df in found.items()])


_TEXT_SHARDS_SQL = """SELECT conv_id, turn, role, md5(text) AS text_md5, length(text) AS chars FROM conversations"""


@query("scan_csv", """SELECT event_id, ts, user_id, event_type, value, CASE WHEN event_id % 7 > 2 THEN props END AS props FROM events""")
def scan_csv(t: Tables) -> DataFrame:
    """Words that stand for a missing value read as NULL."""
    path = scratch_path(t.spark, "csv")
    word = F.get(F.array(F.lit("NA"), F.lit("None"), F.lit("null")), (F.col("event_id") % 7).cast("int"))
    tables.write_csv_shards(t.events.withColumn("props", F.when(F.col("event_id") % 7 > 2, F.col("props")).otherwise(word)), path)
    return tables.scan_csv(t.spark, path, EVENTS_DDL)


@query("scan_csv_shards", _TEXT_SHARDS_SQL)
def scan_csv_shards(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "csv-shards")
    tables.write_csv_shards(t.conversations, path, 20)
    back = tables.scan_csv(t.spark, path, t.conversations.schema)
    return back.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("chars"))


@query("scan_parquet_shards", """SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_returnflag""")
def scan_parquet_shards(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "shards")
    t.lineitem.repartition(20).write.parquet(path)
    back = tables.scan_parquet_shards(t.spark, path, t.lineitem.schema)
    return back.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


def text_vectors(t: Tables) -> DataFrame:
    """Document texts with the vector of the same number, one row per text."""
    keyed = t.documents.select("doc_id", text.text_key(F.col("text")).alias("text_md5")).join(
        t.embeddings.select("vec_id", "embedding"), F.col("doc_id") == F.col("vec_id")
    )
    return keyed.groupBy("text_md5").agg(F.min_by("embedding", "vec_id").alias("embedding"))


VECTORS_SQL = """SELECT md5(text) AS text_md5, arg_min(embedding, vec_id) AS embedding FROM documents JOIN embeddings ON doc_id = vec_id
  GROUP BY md5(text)"""


@query("vector_cache_scan", f"""WITH cache AS ({VECTORS_SQL}) SELECT text_md5, generate_subscripts(embedding, 1)::int - 1 AS slot, unnest(embedding) AS value FROM cache""")
def vector_cache_scan(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "cache")
    vector_cache.vector_cache_append(text_vectors(t), path)
    cache = vector_cache.vector_cache_scan(t.spark, path)
    return cache.select("text_md5", F.posexplode("embedding").alias("slot", "value"))


@query("vector_cache_append", f"""WITH cache AS ({VECTORS_SQL}) SELECT count(*) AS vectors, count(DISTINCT text_md5) AS texts FROM cache""")
def vector_cache_append(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "cache")
    fresh = text_vectors(t)
    vector_cache.vector_cache_append(fresh, path)
    vector_cache.vector_cache_append(fresh, path)  # finds nothing new
    stored = t.spark.read.schema(vector_cache.CACHE_SCHEMA).parquet(path)
    return stored.agg(F.count(F.lit(1)).alias("vectors"), F.countDistinct("text_md5").alias("texts"))


@query("attention_sink", """SELECT (vec_id % 5)::int AS epoch, count(*) AS n, round(sum(w), 4) AS total FROM (
  SELECT vec_id, unnest(embedding)::double AS w FROM embeddings) GROUP BY 1""")
def attention_sink(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "attention")
    weights = t.embeddings.select(
        (F.col("vec_id") % 5).cast("int").alias("epoch"), (F.col("vec_id") % 15).cast("int").alias("batch"), "vec_id",
        F.posexplode("embedding").alias("pos", "weight"),
    )
    tables.attention_sink(weights, path)
    tables.attention_sink(weights.where("epoch = 1"), path)  # an epoch that is run again
    back = t.spark.read.parquet(path)
    return back.groupBy("epoch").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum(F.col("weight").cast("double")), 4).alias("total"))


@query("inspect_table", "SELECT * FROM customer ORDER BY c_custkey LIMIT 5")
def inspect_table(t: Tables) -> DataFrame:
    columns, rows = tables.inspect_table(t.customer.orderBy("c_custkey"), 5)
    return rows.select(*columns)


# ---- projections, predicates, imputation ----


@query("column_subset", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def column_subset(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice")


@query("literal_tag", """SELECT l_orderkey AS key, l_linenumber::bigint AS item, 'line' AS event_type FROM lineitem
  UNION ALL SELECT o_orderkey, 0, 'order' FROM orders""")
def literal_tag(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").cast("long").alias("item"), F.lit("line").alias("event_type"))
    return lines.unionByName(t.orders.select(F.col("o_orderkey").alias("key"), F.lit(0).cast("long").alias("item"), F.lit("order").alias("event_type")))


_TIMED_SQL = "SELECT event_id, CASE WHEN event_type <> 'error' THEN ts END AS event_time FROM events"


def _timed(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.when(F.col("event_type") != "error", F.col("ts")).alias("event_time"))


@query("filter_event_time", f"SELECT * FROM ({_TIMED_SQL}) WHERE event_time IS NOT NULL")
def filter_event_time(t: Tables) -> DataFrame:
    return _timed(t).where(F.col("event_time").isNotNull())


def _lines_of_orders(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))


_LINES_SQL = "lineitem JOIN orders ON l_orderkey = o_orderkey"


@query("flag_in_stay", f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY
  THEN 'True' ELSE 'False' END AS in_stay FROM {_LINES_SQL}""")
def flag_in_stay(t: Tables) -> DataFrame:
    end = F.col("o_orderdate") + F.expr("interval 30 days")
    return _lines_of_orders(t).select(
        "l_orderkey", "l_linenumber", scalars.flag_in_stay(F.col("l_shipdate"), F.col("o_orderdate"), end).alias("in_stay")
    )


@query("flag_nonempty", """SELECT event_id, CASE WHEN length(flag) > 0 THEN 'True' ELSE 'False' END AS flagged FROM (
  SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN '' ELSE event_type END AS flag FROM events)""")
def flag_nonempty(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    flag = F.when(kind == "click", F.lit("")).when(kind != "error", kind)
    return t.events.select("event_id", scalars.flag_nonempty(flag).alias("flagged"))


_FINAL_SQL = "CASE WHEN o_orderstatus = 'F' THEN o_orderdate ELSE o_orderdate + INTERVAL 30 DAY END"


def _final():
    return scalars.final_event_time(
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0), F.col("o_orderdate"), F.col("o_orderdate") + F.expr("interval 30 days")
    )


@query("final_event_time", f"SELECT o_orderkey, {_FINAL_SQL} AS final_time FROM orders")
def final_event_time(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", _final().alias("final_time"))


@query("stay_minutes", """SELECT o_orderkey, date_sub('minute', o_orderdate, o_orderdate + to_seconds(o_orderkey % 100000)) AS minutes FROM orders""")
def stay_minutes(t: Tables) -> DataFrame:
    end = F.col("o_orderdate") + F.make_dt_interval(secs=(F.col("o_orderkey") % 100000).cast("decimal(18,6)"))
    return t.orders.select("o_orderkey", scalars.minutes_between(F.col("o_orderdate"), end).alias("minutes"))


@query("relative_time", f"SELECT l_orderkey, l_linenumber, date_sub('minute', l_shipdate, {_FINAL_SQL}) AS minutes FROM {_LINES_SQL}")
def relative_time(t: Tables) -> DataFrame:
    return _lines_of_orders(t).select("l_orderkey", "l_linenumber", scalars.minutes_between(F.col("l_shipdate"), _final()).alias("minutes"))


@query("value_with_unit", r"""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN 'N/A'
  ELSE regexp_replace(cast(l_quantity AS varchar), '\.0$', '') || ' ' || coalesce(nullif(l_returnflag, 'R'), '') END AS shown FROM lineitem""")
def value_with_unit(t: Tables) -> DataFrame:
    amount = F.when(F.col("l_linenumber") != 2, F.col("l_quantity"))
    shown = text.value_with_unit(amount, F.nullif("l_returnflag", F.lit("R")), "N/A")
    return t.lineitem.select("l_orderkey", "l_linenumber", shown.alias("shown"))


@query("first_non_null", r"""SELECT event_id, coalesce(CASE WHEN event_type = 'click' THEN event_type END,
  CASE WHEN event_type <> 'error' THEN cast(value AS varchar) END, '') AS shown FROM events""")
def first_non_null(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return t.events.select(
        "event_id", F.coalesce(F.when(kind == "click", kind), F.when(kind != "error", F.col("value").cast("string")), F.lit("")).alias("shown")
    )


@query("impute_constant", "SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), 'Unknown') AS priority FROM orders")
def impute_constant(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", fits.impute_constant(F.nullif("o_orderpriority", F.lit("5-LOW"))).alias("priority"))


NULLABLE_SQL = "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN value END AS v FROM events"


def nullable_values(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("v"))


@query("impute_mean", f"SELECT event_id, round(coalesce(v, (SELECT avg(v) FROM ({NULLABLE_SQL}))), 6) AS v FROM ({NULLABLE_SQL})")
def impute_mean(t: Tables) -> DataFrame:
    df = nullable_values(t)
    return df.select("event_id", rounded(fits.impute_mean(df, "v")).alias("v"))


@query("label_coerce", "SELECT doc_id, coalesce(quality, 0) AS label FROM documents LEFT JOIN labels USING (doc_id)")
def label_coerce(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", scalars.label_to_int(F.col("quality")).alias("label"))


@query("text_clean", "SELECT doc_id, md5(coalesce(CASE WHEN lang <> 'en' THEN text END, '')) AS digest FROM documents")
def text_clean(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.text_or_empty(F.when(F.col("lang") != "en", F.col("text")))).alias("digest"))


# ---- joins ----


@query("left_join_two_keys", """SELECT a.l_orderkey, a.l_partkey, a.l_linenumber, b.l_linenumber AS returned_line FROM lineitem a
  LEFT JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND b.l_returnflag = 'R'""")
def left_join_two_keys(t: Tables) -> DataFrame:
    returned = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("returned_line"))
    return cohort.keyed_left_join(t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber"), returned, ["l_orderkey", "l_partkey"])


@query("left_join_three_keys", """SELECT a.l_orderkey, a.l_partkey, a.l_suppkey, a.l_linenumber, b.l_linenumber AS returned_line
  FROM lineitem a LEFT JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey
  AND b.l_returnflag = 'R'""")
def left_join_three_keys(t: Tables) -> DataFrame:
    keys = ["l_orderkey", "l_partkey", "l_suppkey"]
    returned = t.lineitem.where("l_returnflag = 'R'").select(*keys, F.col("l_linenumber").alias("returned_line"))
    return cohort.keyed_left_join(t.lineitem.select(*keys, "l_linenumber"), returned, keys)


@query("patient_history_join", """SELECT o_orderkey, o_custkey, event_id, CASE WHEN ts BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY
  THEN 'True' ELSE 'False' END AS in_stay FROM orders LEFT JOIN events ON user_id = o_custkey""")
def patient_history_join(t: Tables) -> DataFrame:
    history = t.events.select(F.col("user_id").alias("o_custkey"), "event_id", "ts")
    joined = cohort.keyed_left_join(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), history, ["o_custkey"])
    end = F.col("o_orderdate") + F.expr("interval 30 days")
    return joined.select("o_orderkey", "o_custkey", "event_id", scalars.flag_in_stay(F.col("ts"), F.col("o_orderdate"), end).alias("in_stay"))


@query("dictionary_join", """SELECT l_orderkey, l_linenumber, p_name AS title FROM lineitem
  LEFT JOIN part ON l_partkey = p_partkey AND l_linenumber % 2 = p_partkey % 2""")
def dictionary_join(t: Tables) -> DataFrame:
    # code and version: a part is listed in one of two versions, so some lines have no title
    lines = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("code"), (F.col("l_linenumber") % 2).cast("long").alias("version"))
    titles = t.part.select(F.col("p_partkey").alias("code"), (F.col("p_partkey") % 2).alias("version"), F.col("p_name").alias("title"))
    return cohort.dictionary_join(lines, titles, ["code", "version"], "title").drop("code", "version")


@query("left_join_not_null", """SELECT o_orderkey, l_linenumber, l_shipdate FROM orders LEFT JOIN lineitem
  ON l_orderkey = o_orderkey WHERE l_shipdate IS NOT NULL""")
def left_join_not_null(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate")
    return cohort.matched_only(t.orders.select("o_orderkey"), lines, ["o_orderkey"], "l_shipdate")


@query("unused_lookup", """SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  LEFT JOIN customer ON c_custkey = o_custkey""")
def unused_lookup(t: Tables) -> DataFrame:
    # customers are keyed by c_custkey and give no column, so the lookup is left out
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return t.orders.select("o_orderkey").join(lines, "o_orderkey")


@query("vector_cache_lookup", f"""WITH cache AS ({VECTORS_SQL}) SELECT doc_id, md5(text) AS text_md5,
  coalesce(array_to_string([round(x::double * 10000)::bigint for x in embedding], ','), '-') AS slots
  FROM documents LEFT JOIN cache ON cache.text_md5 = md5(text)""")
def vector_cache_lookup(t: Tables) -> DataFrame:
    found = vector_cache.vector_cache_lookup(t.documents.select("doc_id", "text"), "text", text_vectors(t))
    shown = F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 10000).cast("long").cast("string")), ",")
    return found.select("doc_id", "text_md5", F.coalesce(shown, F.lit("-")).alias("slots"))


@query("vector_cache_misses", f"""WITH cache AS ({VECTORS_SQL}) SELECT DISTINCT md5(text) AS text_md5 FROM documents
  WHERE md5(text) NOT IN (SELECT text_md5 FROM cache)""")
def vector_cache_misses(t: Tables) -> DataFrame:
    return vector_cache.vector_cache_misses(vector_cache.distinct_keys(t.documents, "text"), text_vectors(t))


@query("align_by_index", """SELECT user_id, n AS steps, c_mktsegment AS segment, label FROM
  (SELECT user_id, count(*) AS n, arg_min(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END, event_id) AS label FROM events GROUP BY user_id)
  LEFT JOIN customer ON c_custkey = user_id""")
def align_by_index(t: Tables) -> DataFrame:
    lengths = sequences.sequence_lengths(t.events, "user_id").withColumnRenamed("length", "steps")
    marked = t.events.select("user_id", "event_id", F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"))
    labels = sequences.first_row_per_entity(marked, "user_id", ["label"], [F.col("event_id")])
    statics = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return sequences.align_by_entity(lengths, statics, labels, "user_id")


# ---- scalar functions ----


@query("fn_concat", "SELECT event_id, event_type || ':' || nullif(props, props[1:7] || '9}') AS joined FROM events")
def fn_concat(t: Tables) -> DataFrame:
    other = F.nullif("props", F.concat(F.substring("props", 1, 7), F.lit("9}")))
    return t.events.select("event_id", F.concat("event_type", F.lit(":"), other).alias("joined"))


@query("fn_coalesce", "SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), nullif(o_orderstatus, 'F'), 'none') AS v FROM orders")
def fn_coalesce(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.coalesce(F.nullif("o_orderpriority", F.lit("5-LOW")), F.nullif("o_orderstatus", F.lit("F")), F.lit("none")).alias("v"))


@query("fn_ifnull", "SELECT o_orderkey, ifnull(nullif(o_orderstatus, 'F'), '') AS v FROM orders")
def fn_ifnull(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.ifnull(F.nullif("o_orderstatus", F.lit("F")), F.lit("")).alias("v"))


@query("fn_to_text", r"""SELECT event_id, cast(ts AS varchar) AS moment, cast(cast(ts AS date) AS varchar) AS day, cast(user_id AS varchar) AS whole,
  regexp_replace(cast(value AS varchar), '\.0$', '') AS number FROM events""")
def fn_to_text(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id", F.col("ts").cast("string").alias("moment"), F.col("ts").cast("date").cast("string").alias("day"),
        F.col("user_id").cast("string").alias("whole"), text.num_to_text(F.col("value")).alias("number"),
    )


@query("fn_trim", r"""SELECT doc_id, md5(regexp_replace(chr(9) || text || chr(10) || chr(160) || ' ', '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS digest FROM documents""")
def fn_trim(t: Tables) -> DataFrame:
    padded = F.concat(F.lit("\t"), F.col("text"), F.lit("\n\u00a0 "))
    return t.documents.select("doc_id", F.md5(text.strip_white(padded)).alias("digest"))


@query("fn_minutes_between", "SELECT event_id, date_sub('minute', ts, TIMESTAMP '2024-01-15 12:30:30') AS minutes FROM events")
def fn_minutes_between(t: Tables) -> DataFrame:
    return t.events.select("event_id", scalars.minutes_between(F.col("ts"), F.lit("2024-01-15 12:30:30").cast("timestamp_ntz")).alias("minutes"))


@query("fn_case", "SELECT event_id, CASE WHEN value > 100 THEN 'high' WHEN value > 10 THEN 'middle' ELSE 'low' END AS band FROM events")
def fn_case(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.when(F.col("value") > 100, "high").when(F.col("value") > 10, "middle").otherwise("low").alias("band"))


@query("fn_between", "SELECT event_id, value BETWEEN 5 AND 50 AS inside FROM events")
def fn_between(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.col("value").between(5, 50).alias("inside"))


@query("fn_null_and_compare", """SELECT o_orderkey, p IS NOT NULL AND p <> '' AS filled, p = '1-URGENT' AS urgent FROM
  (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS p FROM orders)""")
def fn_null_and_compare(t: Tables) -> DataFrame:
    p = F.nullif("o_orderpriority", F.lit("5-LOW"))
    return t.orders.select("o_orderkey", (p.isNotNull() & (p != "")).alias("filled"), (p == "1-URGENT").alias("urgent"))


@query("fn_struct_array", """SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_quantity) - 1 AS pos, l_shipdate,
  l_linenumber FROM lineitem""")
def fn_struct_array(t: Tables) -> DataFrame:
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_quantity"]
    arrays = ordered.gather(
        t.lineitem.select("l_orderkey", *order), ["l_orderkey"], [F.col(c) for c in order], [F.col(c) for c in order], 100_000, "items"
    )
    rows = arrays.select("l_orderkey", "part", F.posexplode("items").alias("p", "item"))
    return rows.select(
        "l_orderkey", (F.col("part").cast("long") * 100_000 + F.col("p")).alias("pos"), "item.l_shipdate", "item.l_linenumber"
    )


@query("fn_md5", "SELECT doc_id, md5(text) AS digest FROM documents")
def fn_md5(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5("text").alias("digest"))


@query("fn_is_missing", """SELECT event_id, x IS NULL OR isnan(x) AS missing FROM
  (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 'nan'::double ELSE value END AS x FROM events)""")
def fn_is_missing(t: Tables) -> DataFrame:
    kind = F.col("event_id") % 3
    x = F.when(kind == 1, F.lit(float("nan"))).when(kind == 2, F.col("value"))
    return t.events.select("event_id", scalars.is_missing(x).alias("missing"))


@query("fn_sin_cos_pow", """SELECT event_id, round(sin(value), 6) AS s, round(cos(value), 6) AS c,
  round(pow(10000::double, (event_id % 16) / 16::double), 6) AS p FROM events""")
def fn_sin_cos_pow(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id", rounded(F.sin("value")).alias("s"), rounded(F.cos("value")).alias("c"),
        rounded(F.pow(F.lit(10000.0), (F.col("event_id") % 16) / F.lit(16.0))).alias("p"),
    )


@query("fn_exp_log", "SELECT event_id, round(exp(-value / 100), 6) AS e, round(ln(value), 6) AS l FROM events")
def fn_exp_log(t: Tables) -> DataFrame:
    return t.events.select("event_id", rounded(F.exp(-F.col("value") / 100)).alias("e"), rounded(scalars.natural_log(F.col("value"))).alias("l"))


@query("fn_sigmoid", "SELECT event_id, round(1 / (1 + exp(-(value - 50) / 10)), 6) AS p FROM events")
def fn_sigmoid(t: Tables) -> DataFrame:
    return t.events.select("event_id", rounded(scalars.sigmoid((F.col("value") - 50) / 10)).alias("p"))


@query("fn_vector_norm", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) AS norm FROM embeddings")
def fn_vector_norm(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", rounded(vectors.norm(F.col("embedding"))).alias("norm"))


@query("fn_array_length", "SELECT doc_id, len(string_split(text, ' '))::int AS words FROM documents")
def fn_array_length(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(F.split("text", " ")).alias("words"))


# ---- samples and keyed texts ----


@query("sample_fraction", f"""SELECT event_id, user_id FROM events
  WHERE ('0x' || md5('42:' || event_id::varchar)[1:8])::bigint < {int(0.1 * 2**32)}""")
def sample_fraction(t: Tables) -> DataFrame:
    return split.sample_fraction(t.events.select("event_id", "user_id"), "event_id", 0.1)


@query("text_hash", "SELECT conv_id, turn, md5(coalesce(nullif(text, ''), '')) AS text_md5 FROM conversations")
def text_hash(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", text.text_key(F.nullif("text", F.lit(""))).alias("text_md5"))


@query("distinct_texts", "SELECT DISTINCT md5(text) AS text_md5, text FROM documents")
def distinct_texts(t: Tables) -> DataFrame:
    return vector_cache.distinct_texts(t.documents, "text")


_WORDS_SQL = r"""SELECT md5(text) AS text_md5, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS word
  FROM (SELECT DISTINCT text FROM documents)"""


@query("embed_text", f"""SELECT text_md5, slot, round((value / sqrt(sum(value * value) OVER (PARTITION BY text_md5)))::float, 5) AS value FROM (
  SELECT text_md5, (('0x' || md5(word)[1:8])::bigint % 768)::int AS slot, sum(CASE WHEN md5(word)[9] < '8' THEN 1.0::double ELSE -1.0::double END) AS value
  FROM ({_WORDS_SQL}) WHERE word <> '' GROUP BY 1, 2) WHERE value <> 0""")
def embed_text(t: Tables) -> DataFrame:
    cache = embedding.embed_text(t.spark, t.documents, "text", scratch_path(t.spark, "embeddings"))
    slots = cache.select("text_md5", F.posexplode("embedding").alias("slot", "value")).where("value <> 0")
    return slots.select("text_md5", "slot", F.round("value", 5).alias("value"))


_CUT_SQL = _WORDS_SQL.replace("lower(text)", r"lower(array_to_string(regexp_split_to_array(regexp_replace(text, '^[ \t\n\f\r]+', ''), '[ \t\n\f\r]+')[1:16], ' '))")


@query("embed_text_cut", f"""SELECT text_md5, slot, round((value / sqrt(sum(value * value) OVER (PARTITION BY text_md5)))::float, 5) AS value FROM (
  SELECT text_md5, (('0x' || md5(word)[1:8])::bigint % 768)::int AS slot, sum(CASE WHEN md5(word)[9] < '8' THEN 1.0::double ELSE -1.0::double END) AS value
  FROM ({_CUT_SQL}) WHERE word <> '' GROUP BY 1, 2) WHERE value <> 0""")
def embed_text_cut(t: Tables) -> DataFrame:
    cache = embedding.embed_text(t.spark, t.documents, "text", scratch_path(t.spark, "embeddings"), max_tokens=16)
    slots = cache.select("text_md5", F.posexplode("embedding").alias("slot", "value")).where("value <> 0")
    return slots.select("text_md5", "slot", F.round("value", 5).alias("value"))


@query("project_vector", """SELECT vec_id, c::int AS slot, round(sum(x * CASE WHEN md5('42:' || r::varchar || ':' || c::varchar)[1] < '8' THEN 1 ELSE -1 END) / sqrt(16::double), 5) AS value
  FROM (SELECT vec_id, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) - 1 AS r FROM embeddings), range(16) t(c) GROUP BY 1, 2""")
def project_vector(t: Tables) -> DataFrame:
    reduced = embedding.project_vector(t.embeddings, "embedding", 64, 16)
    return reduced.select("vec_id", F.posexplode("projected").alias("slot", "v")).select("vec_id", "slot", rounded(F.col("v"), 5).alias("value"))
