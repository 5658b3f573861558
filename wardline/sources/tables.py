"""Readers and writers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from wardline.sources.schemas import CLINICAL, schema_of


def conform(df: DataFrame, schema: StructType, table: str) -> DataFrame:
    """Check that the needed columns exist and bring them to the declared types, in order."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"{table}: missing columns {missing}")
    same = {f.name: f.dataType for f in df.schema}
    return df.select(*[
        F.col(f.name) if same[f.name] == f.dataType else F.col(f.name).cast(f.dataType).alias(f.name) for f in schema
    ])


def scan_tables(
    spark: SparkSession, root: str, tables: Iterable[str] = CLINICAL, schemas: Mapping[str, str] | None = None
) -> dict[str, DataFrame]:
    """The named tables below ``root``, one Parquet folder or file each, in their declared schemas (the clinical ones by default)."""
    declared = (lambda t: schema_of(t)) if schemas is None else (lambda t: StructType.fromDDL(schemas[t]))
    return {t: conform(spark.read.parquet(f"{root}/{t}.parquet"), declared(t), t) for t in tables}


# Words that common data-frame readers take for a missing value.
MISSING_WORDS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
    "None", "n/a", "nan", "null",
)


def scan_csv(spark: SparkSession, path: str | list[str], schema: StructType | str, missing: Iterable[str] = MISSING_WORDS) -> DataFrame:
    """CSV with a header; quoted text may hold line breaks, commas and doubled quotes.

    Text equal to one of the ``missing`` words reads as NULL; ``missing=()`` keeps them as text.

    A file with line breaks in its quotes cannot be split, so large exports should come in shards:
    a folder or glob reads them all as one table, a file per task. Empty text reads as NULL.
    """
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
        .csv(path)
    )
    words = list(missing)
    if not words:
        return rows
    texts = [f.name for f in rows.schema if isinstance(f.dataType, StringType)]
    return rows.withColumns({c: F.when(~F.col(c).isin(words), F.col(c)) for c in texts})


def write_csv_shards(df: DataFrame, path: str, shards: int | None = None) -> None:
    """Quoted CSV shards with a header each; ``shards`` spreads rows evenly over that many files."""
    out = df if shards is None else df.repartition(shards)
    (
        out.write.mode("errorifexists")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        .csv(path)
    )


def scan_parquet_shards(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """All Parquet shards of a folder as one table."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def attention_sink(weights: DataFrame, path: str) -> None:
    """Attention weights in long form, one folder per epoch, and per batch where there is that column.

    What is written takes the place of the same epochs (and batches); the others stay. So an epoch may be run again.
    """
    parts = ["epoch", *(["batch"] if "batch" in weights.columns else [])]
    weights.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def inspect_table(df: DataFrame, n: int = 5) -> tuple[list[str], DataFrame]:
    """Column names and the first ``n`` rows."""
    return df.columns, df.limit(n)
