"""Cache of text vectors: a Parquet table ``(text_md5, embedding)`` that holds every key once.

Everything works on keys first: texts and vectors are fetched for the keys that are needed and never shuffled to be
compared or merged. A cache made here is bucketed by key, so it is compared and joined where its files lie: only the other
side moves. The number of buckets is that of the shuffle partitions when the cache is made and is kept beside the files.
A folder of Parquet files without it is a plain cache, which works the same but is shuffled.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.text import text_key, text_or_empty
from wardline.session import stored

CACHE_SCHEMA = "text_md5 string, embedding array<float>"
#: Files of a bucket end in its number; others in the folder are not read.
_BUCKET_FILES = "*_[0-9][0-9][0-9][0-9][0-9]*.parquet"
_MARK = "_buckets-"


def _folder(spark: SparkSession, path: str):
    """The file system and the qualified path of a folder."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files, files.makeQualified(folder)


def vector_cache_buckets(spark: SparkSession, path: str) -> int | None:
    """The number of buckets of a cache; None for a plain or missing one."""
    files, folder = _folder(spark, path)
    if not files.exists(folder):
        return None
    names = (status.getPath().getName() for status in files.listStatus(folder))
    return next((int(name.removeprefix(_MARK)) for name in names if re.fullmatch(_MARK + r"\d+", name)), None)


def _bucketed(spark: SparkSession, path: str, buckets: int) -> str:
    """The name of the table over the files; it is made where this catalog lacks it."""
    location = _folder(spark, path)[1].toString()
    name = f"wardline_cache_{hashlib.md5(location.encode()).hexdigest()}_{buckets}"
    quoted = location.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({CACHE_SCHEMA}) USING parquet "
        f"OPTIONS (ignoreCorruptFiles 'true', pathGlobFilter '{_BUCKET_FILES}') "
        f"CLUSTERED BY (text_md5) INTO {buckets} BUCKETS LOCATION '{quoted}'"
    )
    return name


def vector_cache_scan(spark: SparkSession, path: str) -> DataFrame:
    """All cached vectors; unreadable files are skipped and a cache that does not exist is empty."""
    buckets = vector_cache_buckets(spark, path)
    if buckets is not None:
        name = _bucketed(spark, path, buckets)
        spark.catalog.refreshTable(name)  # another application may have added files
        return spark.table(name)
    reader = spark.read.schema(CACHE_SCHEMA).option("ignoreCorruptFiles", "true").option("pathGlobFilter", "*.parquet")
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def vector_cache_create(spark: SparkSession, path: str, buckets: int | None = None) -> int | None:
    """Make an empty bucketed cache unless the folder exists; the number of buckets of the one there is now."""
    files, folder = _folder(spark, path)
    if not files.exists(folder):
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        files.mkdirs(folder)
        files.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"{_MARK}{buckets}")).close()
    return vector_cache_buckets(spark, path)


def one_row_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row of each key, chosen by the least row number; only keys and numbers are shuffled.

    The rows are stored first, so that their numbers do not change between the two reads.
    """
    fixed = stored(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    first = fixed.groupBy(key).agg(F.min("_row").alias("_row"))
    return fixed.join(first.select("_row"), "_row", "left_semi").drop("_row")


def vector_cache_append(vectors: DataFrame, path: str) -> None:
    """Add the vectors whose key the cache lacks; of several new rows with one key one is kept.

    Keys are counted and compared first: where all are known no file is written, where none is known no vector is joined.
    """
    spark = vectors.sparkSession
    buckets = vector_cache_create(spark, path)
    fresh = stored(vectors.select("text_md5", F.col("embedding").cast("array<float>").alias("embedding")), "fresh")
    counted = fresh.groupBy("text_md5").agg(F.count(F.lit(1)).alias("n"))
    wanted = stored(vector_cache_misses(counted, vector_cache_scan(spark, path), buckets), "wanted")
    found = wanted.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    if found.most is None:
        return
    new = fresh
    if found.rows < fresh.count():
        new = fresh.join(wanted.select("text_md5"), "text_md5", "left_semi")
    if found.most > 1:
        new = one_row_per_key(new, "text_md5")
    if buckets is None:
        new.write.mode("append").parquet(path)
    else:
        name = _bucketed(spark, path, buckets)
        new.select("text_md5", "embedding").repartition(buckets, "text_md5").write.mode("append").insertInto(name)


def distinct_keys(df: DataFrame, text: str) -> DataFrame:
    """The cache keys of the texts, each once; merged before the shuffle."""
    return df.select(text_key(F.col(text)).alias("text_md5")).distinct()


def keyed_texts(df: DataFrame, text: str) -> DataFrame:
    """``(text_md5, text)`` of every row."""
    return df.select(text_key(F.col(text)).alias("text_md5"), text_or_empty(F.col(text)).alias("text"))


def texts_of(df: DataFrame, text: str, keys: DataFrame) -> DataFrame:
    """``(text_md5, text)`` for the asked keys, one row each."""
    return one_row_per_key(keyed_texts(df, text).join(keys, "text_md5", "left_semi"), "text_md5")


def distinct_texts(df: DataFrame, text: str) -> DataFrame:
    """One row per distinct cleaned text, with its cache key."""
    return one_row_per_key(keyed_texts(df, text), "text_md5")


def vector_cache_misses(keys: DataFrame, cache: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows of ``keys`` (by ``text_md5``) without a cached vector; with the ``buckets`` of the cache only ``keys`` move."""
    if buckets is not None:
        keys = keys.repartition(buckets, "text_md5")
    return keys.join(cache.select("text_md5"), "text_md5", "left_anti")


def vector_cache_lookup(df: DataFrame, text: str, cache: DataFrame, buckets: int | None = None) -> DataFrame:
    """Add the cached vector of each row's text; NULL where there is none.

    A frequent text makes the left side uneven, which the adaptive skew join splits; the cache side holds a key once.
    With the ``buckets`` of the cache its files stay where they are and rows move to them. As nothing can be split there,
    texts with more than a bucket's share of the rows are counted first: there are fewer of them than buckets, and their
    rows stay in place and get the vectors sent.
    """
    keyed = df.withColumn("text_md5", text_key(F.col(text)))
    vectors = cache.select("text_md5", "embedding")
    if buckets is None:
        return keyed.join(vectors, "text_md5", "left")
    counted = df.select(text_key(F.col(text)).alias("text_md5")).groupBy("text_md5").agg(F.count(F.lit(1)).alias("n"))
    frequent = counted.where(F.col("n") > df.count() / buckets)
    hot = [row.text_md5 for row in frequent.collect()]  # each holds over 1 / buckets of the rows
    if not hot:
        return keyed.repartition(buckets, "text_md5").join(vectors, "text_md5", "left")
    is_hot = F.col("text_md5").isin(hot)
    spread = keyed.where(is_hot).join(F.broadcast(vectors.where(is_hot)), "text_md5", "left")
    return keyed.where(~is_hot).repartition(buckets, "text_md5").join(vectors, "text_md5", "left").unionByName(spread)
