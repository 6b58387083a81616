"""Readers and writers: JSON lines, CSV, Parquet, logs, documents of results, and where they lie."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sidera import schemas


def read_ndjson(spark: SparkSession, path: str, schema: str = schemas.META) -> DataFrame:
    """The columns of the schema; lines that aren't JSON or don't fit are skipped. .gz files are read as they are."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_csv(spark: SparkSession, path: str, required: list[str], schema: str | None = None) -> DataFrame:
    """A CSV with a header; ValueError names the required columns that it lacks."""
    head = spark.read.option("header", True).csv(path)
    missing = [c for c in required if c not in head.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if schema is None:
        return head
    kinds = {f.name: f.dataType for f in T.StructType.fromDDL(schema).fields}
    return head.select(*(F.col(c).cast(kinds.get(c, T.StringType())).alias(c) for c in head.columns))


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_vectors(spark: SparkSession, path: str, column: str = "embedding") -> tuple[DataFrame, int]:
    """The vectors' column and their one dimension; ValueError for none or several."""
    df = spark.read.parquet(path).select(column)
    low, high = df.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if low is None or low != high:
        raise ValueError("no vectors" if low is None else f"vectors of {low} to {high} dimensions")
    return df, low


def latest_by_key(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Of the rows of a key the last in the order of an ordinal column."""
    w = Window.partitionBy(key).orderBy(F.col(ordinal).desc())
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def read_log(spark: SparkSession, path: str, key: str, ordinal: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(latest record by key, keys done: those whose latest record has no error) of a JSON-lines log; bad lines are skipped."""
    latest = latest_by_key(read_ndjson(spark, path, schema), key, ordinal)
    return latest, latest.where(F.col("error").isNull()).select(key)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def rewrite(df: DataFrame, path: str) -> DataFrame:
    """Replaces a Parquet folder that df itself may read: written beside it first, then swapped by renames."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    new, old = (f"{path.rstrip('/')}.{x}-{uuid.uuid4().hex}" for x in ("new", "old"))
    df.write.parquet(new)
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at):
        fs.rename(at, jvm.org.apache.hadoop.fs.Path(old))
    fs.rename(jvm.org.apache.hadoop.fs.Path(new), at)
    fs.delete(jvm.org.apache.hadoop.fs.Path(old), True)
    return spark.read.parquet(path)


def read_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON documents of a file each, with the file's path."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path).withColumn("path", F.input_file_name())


def write_document(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def read_steps(spark: SparkSession, pattern: str, schema: str | None = None) -> DataFrame:
    """Documents of files named step_<n>.json, with n as step, in its order."""
    step = F.regexp_extract("path", r"step_(\d+)\.json$", 1).cast("bigint")
    return read_document(spark, pattern, schema).withColumn("step", step).orderBy("step")


def resolve(candidates: list[str]) -> str | None:
    """The first path that exists, of a canonical and flat layouts."""
    return next((p for p in candidates if os.path.exists(p)), None)
