"""Sinks: verified table loads, CSV exports, JSON reports, the export manifest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ratingloom.sources.readers import fingerprint, require_columns


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """The frame with a row count that the write itself fills in."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def load_check(df: DataFrame, key: str, invalid: Column) -> DataFrame:
    """Rows, distinct keys and invalid rows of a loaded table, one row."""
    return df.agg(
        F.count(F.lit(1)).alias("loaded_rows"),
        F.count_distinct(key).alias("unique_keys"),
        F.count_if(invalid).alias("invalid_rows"),
    )


def _swapped(spark: SparkSession, staged: str, path: str) -> None:
    """Put a staged table in the place of another; the old one goes only when the new one stands."""
    fs, place = _file_system(spark, path)
    old = place(f"{path}.__old")
    if fs.exists(place(path)):
        fs.delete(old, True)
        fs.rename(place(path), old)
    if not fs.rename(place(staged), place(path)):
        fs.rename(old, place(path))
        raise OSError(f"{staged} could not take the place of {path}")
    fs.delete(old, True)


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _restored(spark: SparkSession, path: str) -> bool:
    """Whether a table stands at ``path``; one that a lost driver had moved aside is put back first."""
    fs, place = _file_system(spark, path)
    old = place(f"{path}.__old")
    if not fs.exists(place(path)) and fs.exists(old):
        fs.rename(old, place(path))
    return fs.exists(place(path))


def load_table(
    df: DataFrame, path: str, columns: list[str], key: str, invalid: Column, partition_by: list[str] | None = None
) -> DataFrame:
    """Replace a Parquet table by one that was verified: all rows arrived, keys are unique, no row is invalid.

    The new rows are written beside the old ones and take their place only after the checks; a failed load leaves the
    table as it was.
    """
    spark = df.sparkSession
    source = require_columns(df, columns).select(*columns)
    _restored(spark, path)
    staged = f"{path}.__new-{uuid.uuid4().hex}"
    watched, seen = counted(source)
    writer = watched.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staged)
    expected = seen.get["rows"]
    found = load_check(spark.read.schema(source.schema).parquet(staged), key, invalid).first()
    if (found.loaded_rows, found.unique_keys, found.invalid_rows) != (expected, expected, 0):
        fs, place = _file_system(spark, staged)
        fs.delete(place(staged), True)
        raise AssertionError(f"load of {expected} rows failed: {found.asDict()}")
    _swapped(spark, staged, path)
    return spark.read.schema(source.schema).parquet(path)


def upsert_table(rows: DataFrame, path: str, key: str, invalid: Column | None = None) -> DataFrame:
    """Merge rows into a stored table by key: a row of a known key replaces the stored one, others are added.

    A table that is not there yet is made. Keys of ``rows`` must be unique and known; the merged table is staged, verified
    and swapped in as by ``load_table``.
    """
    spark = rows.sparkSession
    merged = rows
    if _restored(spark, path):
        stored = spark.read.parquet(path)
        merged = stored.join(rows.select(key), key, "left_anti").select(*stored.columns).unionByName(rows)
    wrong = F.col(key).isNull() if invalid is None else F.col(key).isNull() | invalid
    return load_table(merged, path, merged.columns, key, wrong)


def export_csv(df: DataFrame, path: str, single_file: bool = True) -> int:
    """Write a CSV folder with a header and return its rows.

    ``single_file`` is the caller's statement that the result is a summary or a capped list, which one task writes in its
    order; a table of detail rows stays in parts.
    """
    watched, seen = counted(df.coalesce(1) if single_file else df)
    watched.write.mode("overwrite").option("header", True).csv(path)
    return seen.get["rows"]


def write_report(df: DataFrame, path: str) -> None:
    """Write a one-row report as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def export_all(frames: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Export every named frame under ``folder`` and return the rows of each."""
    return {name: export_csv(df, f"{folder}/{name}") for name, df in frames.items()}


def manifest(spark: SparkSession, folder: str, frames: dict[str, DataFrame], rows: dict[str, int]) -> DataFrame:
    """Rows, columns, bytes and SHA-256 of every export; the hash is that of the ordered hashes of its part files."""
    parts = fingerprint(spark, folder).where(F.col("file").like("part-%"))
    name = F.element_at(F.split("path", "/"), -2)
    files = parts.groupBy(name.alias("file")).agg(
        F.sum("bytes").alias("bytes"),
        F.sha2(F.array_join(F.sort_array(F.collect_list("sha256")), ""), 256).alias("sha256"),
    )
    known = spark.createDataFrame(
        [(n, rows[n], len(df.columns)) for n, df in frames.items()], "file string, rows long, columns int"
    )
    return known.join(files, "file").withColumn("source", F.lit("Spark")).orderBy("file")
