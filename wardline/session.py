"""Session settings the library relies on, and the shared folder for what it stores on the way."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only; cluster sizing (executors, memory, shuffle partitions) belongs to the job.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # rows that lie by patient (or by stay) are joined by patient and stay, or admission, where they lie
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
}

# partitions of rows placed by a key, for each shuffle partition
PLACES = 3


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("wardline")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.warehouse.dir", f"/tmp/wardline-{os.getuid()}/warehouse")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own, below ``spark.sql.warehouse.dir``.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return context.getCheckpointDir().rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """Where this application keeps its scratch tables; nobody else writes there."""
    return f"{shared_dir(spark)}/wardline/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the application's scratch folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Remove the application's scratch tables; call it once no result that reads them is needed any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later steps survive lost executors and repeat nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder as a table bucketed by ``key``, a file per bucket.

    Joins and groups on ``key``, or on ``key`` and more, read it in place. The files go with the other scratch tables.
    """
    spark = df.sparkSession
    buckets = placement(spark)
    path = scratch_path(spark, label)
    name = f"wardline_{label}_{path.rsplit('-', 1)[1]}"
    rows = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    rows.option("path", path).option("compression", "zstd").saveAsTable(name, format="parquet")
    return spark.table(name)


def placement(spark: SparkSession) -> int:
    """The number of partitions of rows placed by a key, the same in all tables, so that they meet without a shuffle.

    Texts of all kinds are sorted beside each other in one task there, so a task gets a share of what it gets elsewhere.
    """
    return PLACES * int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are stored in the shared folder and survive lost executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
