"""Scans and schema contracts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ratingloom.sources.schema import COLUMN_MAP, RAW_SCHEMA


def read_ratings(spark: SparkSession, path: str, schema: StructType = RAW_SCHEMA) -> DataFrame:
    """Published-ratings CSV with an explicit schema; a malformed row or another header fails."""
    header = spark.read.option("header", True).csv(path)
    check_header(header, schema.fieldNames())
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def check_header(df: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """The frame itself when its columns are exactly the expected ones in order."""
    wanted = expected or list(COLUMN_MAP)
    if df.columns != wanted:
        raise ValueError(f"expected columns {wanted}, found {df.columns}")
    return df


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Required columns the frame lacks, sorted."""
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def rename(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    return df.withColumnsRenamed(names or COLUMN_MAP)


def to_numeric(df: DataFrame, types: dict[str, str], errors: str = "raise") -> DataFrame:
    """Cast columns; ``raise`` fails the job on text that is no number, ``coerce`` turns it to null."""
    if errors not in ("raise", "coerce"):
        raise ValueError(f"unknown errors mode {errors!r}")

    def converted(name: str, kind: str):
        source = F.col(name)
        if errors == "coerce":
            return source.try_cast(kind)
        failed = source.isNotNull() & source.try_cast(kind).isNull()
        broken = F.raise_error(F.concat(F.lit(f"{name} is not numeric: "), source.cast("string")))
        return F.when(failed, broken.cast(kind)).otherwise(source.try_cast(kind))

    return df.withColumns({name: converted(name, kind) for name, kind in types.items()})


def source_types(df: DataFrame) -> DataFrame:
    """Column inventory: position, name, type."""
    rows = [(i, name, kind) for i, (name, kind) in enumerate(df.dtypes, start=1)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, data_type string")


# what the readers would unpack; such files are hashed as one row each
_PACKED = r"\.(gz|bz2|lz4|snappy|zst|deflate)$"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of every file from its lines in order; the length tells what the reader left out of it."""
    rows = (row for b in batches for row in zip(*(b.column(i) for i in range(3)), strict=True))
    for path, lines in groupby(rows, lambda row: row[0].as_py()):
        # the reader drops a mark at the very beginning and does not say whether the last line was ended
        plain, marked, seen, size = hashlib.sha256(), hashlib.sha256(b"\xef\xbb\xbf"), -1, 0
        for _, length, line in lines:
            size, part = length.as_py(), line.as_buffer()
            for digest in (plain, marked):
                if seen >= 0:
                    digest.update(b"\n")
                digest.update(part)
            seen += 1 + len(part)
        left = size - seen
        found = {0: plain, 1: plain, 3: marked, 4: marked}.get(left)
        if found is None:
            raise ValueError(f"{path} was not read as it is stored")
        if left in (1, 4):
            found.update(b"\n")
        yield pa.record_batch([pa.array([path]), pa.array([found.hexdigest()])], ["path", "sha256"])


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and SHA-256 of every file under a path, hashed by the executors that read them.

    Files are read as lines, in blocks, and stream into their digest in order, so a file of any size takes the memory of
    its longest line. Packed files, which a line reader would unpack, are read whole. Files without bytes are not listed.
    """
    where, size = F.col("_metadata.file_path"), F.col("_metadata.file_size")
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = whole.select(where.alias("path"), size.alias("bytes"))
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    placed = lines.where(~where.rlike(_PACKED)).select(
        where.alias("path"),
        size.alias("length"),
        F.col("value").cast("binary").alias("line"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("slot"),
    )
    in_order = placed.repartition("path").sortWithinPartitions("path", "block", "slot").select("path", "length", "line")
    streamed = in_order.mapInArrow(_digests, "path string, sha256 string")
    packed = whole.where(where.rlike(_PACKED)).select(where.alias("path"), F.sha2("content", 256).alias("sha256"))
    known = streamed.unionByName(packed)
    return files.join(known, "path", "left").select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("file"),
        "bytes",
        "sha256",
    )
