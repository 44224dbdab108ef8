"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source is wanted ``ratio`` times, target words over source words. The whole part of the ratio is given to
every document; the fractional parts are rounded by the pivotal method: two units meet, mass moves at random from one to
the other until one of them is 0 or 1, and the other goes on with the rest. Units of like size meet first, so the words
taken stay near the target and not only the number of copies. Groups of about ``GROUP`` units fold at once; each sends its
one open unit to the next level, so the levels form a tree of fan-in ``GROUP`` whatever the number of rows.

Nulls and odd rows: a null source is a source of its own, last in order; a null text has size 0; documents of size 0
take 0 words and no part in the rounding; repeated rows are units of their own, counted first and then numbered, so that
they spread over groups like other rows; a table without words has targets 0.
Draws are hashes of seed and ids, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratingloom.llm.store import WORD, cut, uniform, with_small

GROUP = 64
CAP = 3
WEIGHTS = (5, 2, 1)
SEED = 20_011
# repeats of one row that are numbered together
BLOCK = 10_000
_EDGE = 1e-12


def text_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: (source, source_size, target) from rows (source, size).

    Shares follow the repeating weights; a target stops at ``cap`` times its source and the excess is shared again among
    the rest, which is the level ``target = min(cap * size, level * weight)`` that spends exactly the total. Sources sorted
    by ``cap * size / weight`` fill up in that order, so the level follows from running sums over one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (position % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("__weight", weight).withColumn("__limit", (F.lit(cap) * F.col("source_size")).cast("double"))
    filling = Window.orderBy(F.col("__limit") / F.col("__weight"), F.col("source").asc_nulls_last())
    before, onward = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    everything = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("__limit").over(before), F.lit(0.0))) / F.sum(
        "__weight"
    ).over(onward)
    levelled = ranked.withColumn("__level", level)
    full = F.col("__limit") <= F.col("__level") * F.col("__weight")
    final = F.first(F.when(~full, F.col("__level")), ignorenulls=True).over(everything)
    return levelled.withColumn("__final", final).select(
        "source", "source_size", F.when(full, F.col("__limit")).otherwise(F.col("__final") * F.col("__weight")).alias("target")
    )


_UNIT = "struct<size:bigint,doc_id:bigint,copy:bigint,p:double>"
_DONE = "array<struct<size:bigint,doc_id:bigint,extra:bigint>>"


def _folded(units: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """One row per group: ``open`` goes on to the next level, ``done`` holds the decided units."""

    def unit(of: Column, p: Column) -> Column:
        return F.struct(*[of[name].alias(name) for name in ("size", "doc_id", "copy")], p.alias("p"))

    def decided(of: Column, extra: Column) -> Column:
        return F.struct(of["size"].alias("size"), of["doc_id"].alias("doc_id"), extra.cast("long").alias("extra"))

    def meet(state: Column, x: Column) -> Column:
        a = state["open"]
        total = a["p"] + x["p"]
        draw = uniform(seed, *[side[name] for side in (a, x) for name in ("doc_id", "size", "copy")])
        over = total >= 1
        # below 1 the survivor holds all mass and the other gets 0; from 1 on the other gets 1 and the survivor the rest
        x_goes_on = F.when(over, draw * (2 - total) < 1 - x["p"]).otherwise(draw * total >= a["p"])
        left = F.when(over, total - 1).otherwise(total)
        extra = F.when(over, 1).otherwise(0)
        met = F.when(
            x_goes_on, F.struct(unit(x, left).alias("open"), F.array_append(state["done"], decided(a, extra)).alias("done"))
        ).otherwise(F.struct(unit(a, left).alias("open"), F.array_append(state["done"], decided(x, extra)).alias("done")))
        first = F.struct(unit(x, x["p"]).alias("open"), state["done"].alias("done"))
        return F.when(a.isNull(), first).otherwise(met)

    grouped = units.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("size", "doc_id", "copy", "p"))).alias("__units"))
    start = F.struct(F.lit(None).cast(_UNIT).alias("open"), F.array().cast(_DONE).alias("done"))
    return grouped.select(*keys, F.aggregate("__units", start, meet).alias("__state")).select(
        *keys, F.col("__state.open").alias("open"), F.col("__state.done").alias("done")
    )


def _numbered(units: DataFrame, block: int) -> DataFrame:
    """Rows with the number ``copy`` that tells repeats apart.

    Repeats are counted before they move, so a row that stands in a third of the table is one row on the wire; its count
    is dealt in blocks and each block numbers its own. The numbers do not depend on where the rows lie.
    """
    same = units.columns
    counted = units.groupBy(*same).agg(F.count(F.lit(1)).alias("__n"))
    dealt = counted.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(block).cast("long"))))
    dealt = dealt.repartition("doc_id", "size", "__from")
    last = F.least(F.col("__from") + block, F.col("__n")) - 1
    return dealt.select(*same, F.explode(F.sequence("__from", last)).alias("copy"))


def _extras(units: DataFrame, group: int, seed: int) -> DataFrame:
    """(source, doc_id, size, extra) with extra 0 or 1 for rows (source, doc_id, size, p) with p between 0 and 1."""
    sized = _numbered(units, BLOCK).withColumn("__class", F.floor(F.log2(F.col("size").cast("double"))).cast("int"))
    counts = cut(sized.groupBy("source", "__class").agg(F.ceil(F.count(F.lit(1)) / F.lit(group)).alias("__groups")))
    placed = with_small(sized, counts, ["source", "__class"]).withColumn(
        "__group", F.pmod(F.xxhash64("doc_id", "size", "copy"), F.col("__groups"))
    )
    levels, level, keys = [], 0, ["source", "__class", "__group"]
    while True:
        folded = cut(_folded(placed, keys, seed + level))
        levels.append(folded.select("source", F.inline("done")))
        waiting = folded.select("source", "open.*").withColumn("__class", F.lit(0))
        counts = cut(waiting.groupBy("source").agg(F.count(F.lit(1)).alias("__n")))
        most = counts.agg(F.max("__n")).first()[0] or 0
        if most <= 1:
            break
        placed = with_small(waiting, counts, ["source"]).withColumn(
            "__group", F.pmod(F.xxhash64("doc_id", "size", "copy"), F.ceil(F.col("__n") / F.lit(group)))
        )
        level += 1
    last = waiting.select(
        "source", "size", "doc_id", (uniform(seed - 1, F.col("doc_id"), F.col("size"), F.col("copy")) < F.col("p")).cast("long").alias("extra")
    )
    for part in levels:
        last = last.unionByName(part.select("source", "size", "doc_id", "extra"))
    return last


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP,
    group: int = GROUP,
    seed: int = SEED,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row per input row."""
    sizes = cut(
        docs.select(
            F.col(id_column).cast("long").alias("doc_id"),
            F.col(source_column).cast("string").alias("source"),
            text_words(F.col(text_column)).alias("size"),
        )
    )
    targets = cut(source_targets(sizes, weights, cap))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    split = targets.withColumn("__whole", F.floor(ratio)).withColumn("__p", ratio - F.floor(ratio))
    wanted = with_small(sizes, split, ["source"])
    drawn = (F.col("size") > 0) & (F.col("__p") > _EDGE)
    extras = _extras(wanted.where(drawn).select("source", "doc_id", "size", F.col("__p").alias("p")), group, seed)
    rounded = with_small(extras, split, ["source"]).withColumn("copies", F.col("__whole") + F.col("extra"))
    settled = wanted.where(~drawn).withColumn("copies", F.when(F.col("size") > 0, F.col("__whole")).otherwise(F.lit(0)))
    columns = ["doc_id", "source", "size", "source_size", "target", "copies"]
    both = rounded.select(*columns).unionByName(settled.select(*columns))
    return both.withColumn("copies", F.col("copies").cast("long")).withColumn("taken", F.col("copies") * F.col("size"))

