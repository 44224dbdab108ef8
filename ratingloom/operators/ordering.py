"""Positions, ranks, running totals and top-k that hold when one group has most of the rows.

Orders are given as names, with a leading ``-`` for descending. Per-row operators range-partition on the full sort key, so
a single group spreads over many tasks, and the per-partition sizes, at most one row per group and partition, give the
offsets. ``summary_rank`` is for frames that are aggregated already, where a group is a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratingloom.operators.joins import join_on_keys, join_summary
from ratingloom.session import shared_folder, stored

_PART = "__part"
_SLOT = "__slot"
# numbers of one of Spark's bitmaps, which takes 4 KB, and bitmaps that are sent to every task at most
BITMAP, BITMAPS = 32_768, 10_000
# leading hexadecimal digits that a keyed sample counts its rows by
DIGITS = 4


def order_columns(order: list[str]) -> list[Column]:
    return [F.col(name[1:]).desc() if name.startswith("-") else F.col(name).asc() for name in order]


def order_names(order: list[str]) -> list[str]:
    return [name.lstrip("-") for name in order]


def _placed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows in range partitions of the sort key, with partition and slot fixed by a stored copy.

    Range bounds come from a sample, so a second evaluation could place rows elsewhere. The copy makes the placement a
    stored fact that every later stage and every retry reads back. It is Parquet, because a checkpoint keeps rows
    unpacked and takes several times the disk.
    """
    by = [F.col(key) for key in keys] + order_columns(order)
    placed = (
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn(_PART, F.spark_partition_id())
        .withColumn(_SLOT, F.monotonically_increasing_id())
    )
    return stored(placed, "placed")


def _offsets(placed: DataFrame, keys: list[str], *aggregates: Column, carry: str) -> DataFrame:
    """Per (partition, group) aggregates plus the total of ``carry`` in earlier partitions."""
    groups = placed.groupBy(_PART, *keys).agg(*aggregates)
    earlier = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    return groups.withColumn("__before", F.coalesce(F.sum(carry).over(earlier), F.lit(0)))


def row_position(
    df: DataFrame,
    order: list[str],
    keys: list[str] | tuple = (),
    name: str = "position",
    start: int = 1,
) -> DataFrame:
    """Dense position of each row in its group under a total order."""
    keys = list(keys)
    placed = _placed(df, keys, order)
    offsets = _offsets(
        placed, keys, F.count(F.lit(1)).alias("__rows"), F.min(_SLOT).alias("__first"), carry="__rows"
    )
    joined = join_summary(placed, offsets, [_PART, *keys])
    position = F.col("__before") + F.col(_SLOT) - F.col("__first") + F.lit(start)
    return joined.withColumn(name, position.cast("long")).drop(_PART, _SLOT, "__rows", "__first", "__before")


def natural_position(df: DataFrame, name: str = "source_row_number", start: int = 2) -> DataFrame:
    """Number the rows of a file source by path, place of the block in its file and row in the block; 2 skips a header.

    Spark packs the blocks of files into partitions in an order of its own, so blocks are put in order by what they are,
    not by where they were read. The placement is stored once; later stages cannot disagree about it.
    """
    shared_folder(df.sparkSession)
    block = ["__file", "__block"]
    placed = (
        df.withColumns({"__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start")})
        .withColumn(_SLOT, F.monotonically_increasing_id())
        .checkpoint()
    )
    blocks = placed.groupBy(*block).agg(F.count(F.lit(1)).alias("__rows"), F.min(_SLOT).alias("__first"))
    # one row per block of a file
    earlier = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("__before", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))
    joined = join_summary(placed, offsets, block)
    number = F.col("__before") + F.col(_SLOT) - F.col("__first") + F.lit(start)
    return joined.select(number.cast("long").alias(name), *df.columns)


def _bitmap_rank(df: DataFrame, order: str) -> DataFrame | None:
    """Rows with ``__key``, the rank of a whole number; None where a number is missing, repeats or lies too far from the others."""
    if dict(df.dtypes)[order] not in ("tinyint", "smallint", "int", "bigint"):
        return None
    number = F.col(order).cast("long")
    low, high, rows, known = df.agg(F.min(number), F.max(number), F.count(F.lit(1)), F.count(number)).first()
    if not rows or known < rows or (high - low) // BITMAP >= BITMAPS:
        return None
    offset = number - F.lit(low)
    bit = F.pmod(offset, F.lit(BITMAP))
    bucket = F.floor((offset - bit) / BITMAP).cast("long").alias(_PART)
    maps = df.select(bucket, bit.alias("__bit")).groupBy(_PART).agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    maps = stored(maps.withColumn("__rows", F.bitmap_count("__bits")), "bitmaps")
    if maps.agg(F.sum("__rows")).first()[0] < rows:
        return None
    # one row for BITMAP numbers
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    maps = maps.select(_PART, "__bits", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"))
    whole = (bit / 8).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), whole + 1, F.lit(1))), 16, 10).cast("int")
    inside = F.bitmap_count(F.substring(F.col("__bits"), F.lit(1), whole))
    upto = F.element_at(F.array(*[F.lit((2 << k) - 1) for k in range(8)]), (bit % 8).cast("int") + 1)
    key = F.col("__before") + inside + F.bit_count(byte.bitwiseAND(upto))
    joined = df.withColumn(_PART, bucket).join(F.broadcast(maps), _PART)
    return joined.select(key.cast("long").alias("__key"), *df.columns)


def dense_key(df: DataFrame, order: str, name: str = "vehicle_id") -> DataFrame:
    """Surrogate key 1..N in the order of a unique column, however sparse its values are.

    Whole numbers that are close enough are ranked by bitmaps of those that occur, so no row moves."""
    if (ranked := _bitmap_rank(df, order)) is not None:
        return ranked.select(F.col("__key").alias(name), *df.columns)
    keyed = row_position(df, [order], name="__key")
    return keyed.select(F.col("__key").alias(name), *df.columns)


def summary_rank(df: DataFrame, order: list[str], keys: list[str] | tuple = (), name: str = "rank") -> DataFrame:
    """RANK with gaps on ties for an aggregated frame; a group is sorted in one task."""
    window = Window.partitionBy(*keys).orderBy(*order_columns(order))
    return df.withColumn(name, F.rank().over(window).cast("long"))


def summary_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Dense position 1..N for a frame of a few aggregated rows."""
    window = Window.orderBy(*order_columns(order))
    return df.withColumn(name, F.row_number().over(window).cast("long"))


def running_totals(
    df: DataFrame,
    order: list[str],
    weight: str,
    keys: list[str] | tuple = (),
    name: str = "running",
) -> DataFrame:
    """Inclusive running sum of ``weight`` in each group; the order must be unique within a group."""
    keys = list(keys)
    placed = _placed(df, keys, order)
    offsets = _offsets(placed, keys, F.sum(weight).alias("__sum"), carry="__sum")
    local = Window.partitionBy(_PART, *keys).orderBy(_SLOT)
    running = placed.withColumn(
        "__local", F.sum(weight).over(local.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    joined = join_summary(running, offsets, [_PART, *keys])
    return joined.withColumn(name, F.col("__local") + F.col("__before")).drop(
        _PART, _SLOT, "__local", "__sum", "__before"
    )


def with_rank(
    df: DataFrame,
    order: list[str],
    keys: list[str] | tuple = (),
    name: str = "rank",
) -> DataFrame:
    """RANK with gaps on ties; rows collapse to counted values before those are ranked."""
    keys = list(keys)
    by = [*keys, *[n for n in order_names(order) if n not in keys]]
    values = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    totals = running_totals(values, order, "__n", keys, "__running")
    ranks = totals.select(*by, (F.col("__running") - F.col("__n") + 1).cast("long").alias(name))
    return join_on_keys(df, ranks, by)


def with_cume_dist(
    values: DataFrame,
    value: str,
    count: str,
    keys: list[str] | tuple = (),
    name: str = "cume_dist",
) -> DataFrame:
    """CUME_DIST of each distinct value from its row count; ties share the upper share."""
    keys = list(keys)
    totals = running_totals(values, [value], count, keys, "__running")
    sizes = values.groupBy(*keys).agg(F.sum(count).alias("__total"))
    share = F.col("__running") / F.col("__total")
    if keys:
        return join_summary(totals, sizes, keys).withColumn(name, share).drop("__running", "__total")
    return totals.withColumn("__total", sizes.scalar()).withColumn(name, share).drop("__running", "__total")


def with_tile(
    df: DataFrame,
    order: list[str],
    tiles: int,
    keys: list[str] | tuple = (),
    name: str = "tile",
) -> DataFrame:
    """NTILE under a total order: the first ``rows % tiles`` tiles hold one row more."""
    keys = list(keys)
    placed = row_position(df, order, keys, "__position")
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    sized = join_summary(placed, sizes, keys) if keys else placed.withColumn("__rows", sizes.scalar())
    small, extra = F.floor(F.col("__rows") / tiles), F.col("__rows") % tiles
    long_span = extra * (small + 1)
    tile = F.when(
        F.col("__position") <= long_span, F.ceil(F.col("__position") / (small + 1))
    ).otherwise(extra + F.ceil((F.col("__position") - long_span) / F.nullif(small, F.lit(0))))
    return sized.withColumn(name, tile.cast("int")).drop("__position", "__rows")


def top_n(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """First ``n`` rows of a total order; Spark keeps ``n`` rows per task, there is no full sort."""
    return df.orderBy(*order_columns(order)).limit(n)


def head_by(df: DataFrame, key: str, n: int) -> DataFrame:
    return top_n(df, [key], n)


def top_n_displayed(df: DataFrame, order: list[str], n: int, display: list[str]) -> DataFrame:
    """The top ``n`` rows put in another order for display."""
    return top_n(df, order, n).orderBy(*order_columns(display))


def sample_cap(df: DataFrame, n: int, seed: int, key: list[str]) -> DataFrame:
    """All rows up to ``n``; beyond that a reproducible pseudo-random ``n`` of them, left in the partitions they are in.

    Rows are ordered by a digest of seed and key, so the sample does not depend on partitioning. The ``n``-th smallest
    digest is found by its leading digits: rows are counted by the first ``DIGITS`` hexadecimal digits, combined before
    the shuffle into at most 16^DIGITS counts; all rows below the digits at which the count passes ``n`` are taken, and
    those at these digits are counted by the next ones. What two counts leave open is about one row in 16^(2 DIGITS), and
    only that is put in order.
    """
    spelled = F.concat_ws("|", F.lit(str(seed)), *[F.col(name).cast("string") for name in key])
    drawn = df.withColumn("__draw", F.md5(spelled))
    digits = F.col("__draw")
    taken, left, prefix = None, n, ""
    for level in (1, 2):
        found = _crossing(drawn.where(digits.startswith(prefix)), F.substring(digits, 1, level * DIGITS), left)
        if found is None:
            return df
        left, prefix = left - found["before"], found["digits"]
        below = F.substring(digits, 1, level * DIGITS) < F.lit(prefix)
        taken = below if taken is None else taken | below
    edge = row_position(drawn.where(digits.startswith(prefix)), ["__draw", *key], name="__spot")
    last = edge.where(F.col("__spot") <= left).drop("__spot")
    return drawn.where(taken).unionByName(last).drop("__draw")


def _crossing(df: DataFrame, digits: Column, n: int):
    """The digits at which the count of rows, digits ascending, reaches ``n``, and the rows before; None for fewer rows."""
    counts = df.groupBy(digits.alias("digits")).agg(F.count(F.lit(1)).alias("rows"))
    # at most 16^DIGITS rows
    running = F.sum("rows").over(Window.orderBy("digits").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = counts.withColumn("running", running)
    crossed = summed.where(F.col("running") >= n).orderBy("digits")
    return crossed.select("digits", (F.col("running") - F.col("rows")).alias("before")).first()
