"""Stored tables that are replaced and merged, streamed digests, bitmaps of entities, the keyed sample and permutation."""

import hashlib
import os
import time

import pytest
from pyspark.sql import functions as F

from ratingloom.operators import cube as K, models as ML
from ratingloom.operators.ordering import sample_cap
from ratingloom.sources import writers as IO
from ratingloom.sources.readers import fingerprint
from ratingloom.session import CLEANUP, stored

ROWS = "code long, name string"


def contents(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).collect()))


def test_upsert_replaces_and_adds(spark, tmp_path):
    path = str(tmp_path / "lookup")
    IO.upsert_table(spark.createDataFrame([(1, "a"), (2, "b")], ROWS), path, "code")
    IO.upsert_table(spark.createDataFrame([(2, "B"), (3, None)], ROWS), path, "code")
    assert contents(spark, path) == [(1, "a"), (2, "B"), (3, None)]
    assert sorted(os.listdir(tmp_path)) == ["lookup"]


@pytest.mark.parametrize("rows", [[(2, "x"), (2, "y")], [(None, "x")]])
def test_failed_upsert_leaves_the_table(spark, tmp_path, rows):
    path = str(tmp_path / "lookup")
    IO.upsert_table(spark.createDataFrame([(1, "a"), (2, "b")], ROWS), path, "code")
    with pytest.raises(AssertionError):
        IO.upsert_table(spark.createDataFrame(rows, ROWS), path, "code")
    assert contents(spark, path) == [(1, "a"), (2, "b")] and sorted(os.listdir(tmp_path)) == ["lookup"]


def test_failed_load_leaves_the_table_and_a_moved_one_is_found_again(spark, tmp_path):
    path = str(tmp_path / "facts")
    good = spark.createDataFrame([(1, "a"), (2, "b")], ROWS)
    IO.load_table(good, path, ["code", "name"], "code", F.lit(False))
    with pytest.raises(AssertionError):
        IO.load_table(good, path, ["code", "name"], "code", F.col("code") == 2)
    assert contents(spark, path) == [(1, "a"), (2, "b")]
    # a driver that was lost between the two renames
    os.rename(path, f"{path}.__old")
    IO.upsert_table(spark.createDataFrame([(3, "c")], ROWS), path, "code")
    assert contents(spark, path) == [(1, "a"), (2, "b"), (3, "c")]


def test_fingerprints_stream_any_file(spark, tmp_path):
    import gzip

    block = os.urandom(50_000)
    files = {
        "ended": b"a,b\n1,2\n", "open": b"a,b\n1,2", "windows": b"a\r\nb\r\n", "marked": b"\xef\xbb\xbfa\nb\n",
        "marked_open": b"\xef\xbb\xbfa\nb", "blank": b"\n\n\n", "one": b"x", "random": block * 40, "text": b"line of text\n" * 400_000,
        "packed.gz": gzip.compress(b"a\nb\n"), "deep/er": b"\xff\xfe\n\x00",
    }
    (tmp_path / "deep").mkdir()
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        found = {r["file"]: (r["bytes"], r["sha256"]) for r in fingerprint(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert found == {n.split("/")[-1]: (len(d), hashlib.sha256(d).hexdigest()) for n, d in files.items()}


def test_entity_cube_counts_under_any_filter(spark):
    rows = [(y, c, (7 * y + 31 * i) % 90_000) for y in (1, 2, 3) for c in "ab" for i in range(300)] + [(1, "a", None)]
    df = spark.createDataFrame(rows, "year int, kind string, part long").repartition(3)
    cube = K.entity_cube(df, ["year", "kind"], "part")
    for rule in ("year >= 2", "kind = 'a'", "year = 9", "true"):
        wanted = df.where(rule).select(F.count_distinct("part")).first()[0]
        assert K.distinct_entities(cube.where(rule)).first()[0] == wanted
    by_year = {r["year"]: r["distinct_entities"] for r in K.distinct_entities(cube, ["year"]).collect()}
    assert by_year == {y: len({r[2] for r in rows if r[0] == y and r[2] is not None}) for y in (1, 2, 3)}


@pytest.mark.parametrize("n", [0, 1, 7, 500, 2_999, 3_000, 5_000])
def test_keyed_sample_is_the_one_of_smallest_digests(spark, n):
    df = spark.range(3_000, numPartitions=6).withColumn("other", F.lit("x"))
    found = sample_cap(df, n, 42, ["id"])
    wanted = sorted(range(3_000), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())[:n]
    assert sorted(r["id"] for r in found.collect()) == sorted(wanted) and found.columns == ["id", "other"]
    if n == 500:
        assert found.select(F.spark_partition_id()).distinct().count() > 1


@pytest.mark.parametrize("rows", [1, 2, 3, 5, 64, 65, 1_000])
def test_permuted_places_are_a_permutation(spark, rows):
    df = spark.range(rows).select("id", *[ML.permuted(F.col("id"), rows, F.lit(42), F.lit(r)).alias(f"p{r}") for r in (1, 2)])
    found = df.collect()
    for r in ("p1", "p2"):
        assert sorted(x[r] for x in found) == list(range(rows))
    if rows > 60:
        assert sum(x["p1"] == x["id"] for x in found) < 10 and [x["p1"] for x in found] != [x["p2"] for x in found]
        # neighbours do not stay neighbours
        assert sum(abs(a["p1"] - b["p1"]) == 1 for a, b in zip(found, found[1:])) < rows / 10


def test_a_stored_frame_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before, setting = shuffles(), spark.conf.get(CLEANUP, None)
    frame = stored(spark.range(1_000).repartition(7, "id"), "moved")
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before and spark.conf.get(CLEANUP, None) == setting and frame.count() == 1_000
