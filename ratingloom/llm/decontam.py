"""Benchmark decontamination: a prefix-filtered containment join between item windows and whole documents.

Benchmark items become windows of ``width`` consecutive words (a shorter item is one window). A document must hold every
word of a window, so one necessary word is enough as its prefix: the rarest by its count over all documents. Documents are
probed with their words against those prefixes; the offset of the prefix word in its window gives the only possible start,
length bounds drop starts that leave the document, and the words at that place are compared exactly.

Nulls and odd rows: null or wordless texts have no words and no hits; rows that repeat a document are each returned;
items without words have no window; windows that several items share count for each; an empty table on either side gives
no hits. Ties in rarity go to the smaller word, then to its first place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ratingloom.llm.store import SMALL_ROWS, cut, lowered

WIDTH = 10
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def text_words(text: Column) -> Column:
    """Runs of letters, digits and characters beyond ASCII, lower-cased in A-Z; none for null."""
    return F.array_remove(F.split(F.coalesce(lowered(text), F.lit("")), BREAK), "")


def item_windows(benchmark: DataFrame, width: int = WIDTH, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(item_id, window), the window as its words joined by a space; one row per distinct pair."""
    words = benchmark.select(F.col(id_column).alias("item_id"), text_words(F.col(text_column)).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    windows = F.transform(starts, lambda at: F.array_join(F.slice("words", at, width), " "))
    return words.where(F.size("words") > 0).select("item_id", F.explode(windows).alias("window")).distinct()


def _probe(words: DataFrame, small: DataFrame, rows: int, limit: int) -> DataFrame:
    """Words of documents joined with the given words; the documents' side never shuffles while the other is small."""
    return words.join(F.broadcast(small) if rows <= limit else small, "word")


def _prefixes(windows: DataFrame, docs_words: DataFrame, limit: int) -> DataFrame:
    """(word, offset, n, window): each distinct window under its rarest word."""
    distinct = cut(windows.select("window").distinct())
    placed = distinct.select("window", F.posexplode(F.split("window", " ")).alias("offset", "word"))
    vocabulary = cut(placed.select("word").distinct())
    words = docs_words.select(F.explode("words").alias("word"))
    counts = _probe(words, vocabulary, vocabulary.count(), limit).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarity = F.struct(F.coalesce("n", F.lit(0)), "word", "offset")
    rarest = placed.join(counts, "word", "left").groupBy("window").agg(F.min(rarity).alias("least"))
    return rarest.select(
        F.col("least.word").alias("word"),
        F.col("least.offset").alias("offset"),
        F.size(F.split("window", " ")).alias("n"),
        "window",
    )


def window_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    limit: int = SMALL_ROWS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(doc_id, mark, n_words, start, n, window): every verified occurrence, and one row without window per row of ``docs``.

    ``mark`` is a hash of the text, so that equal ids with unequal texts stay apart. Beyond ``limit`` prefixes the words are
    shuffled on their own and only documents with a candidate are joined again for the comparison.
    """
    split = docs.select(
        F.col(id_column).alias("doc_id"), F.xxhash64(text_column).alias("mark"), text_words(F.col(text_column)).alias("words")
    )
    prefixes = cut(_prefixes(item_windows(benchmark, width), split, limit))
    total = prefixes.count()
    start = (F.col("at") - F.col("offset") + 1).alias("start")
    fits = (F.col("start") >= 1) & (F.col("start") + F.col("n") - 1 <= F.col("n_words"))
    same = F.array_join(F.expr("slice(words, start, n)"), " ") == F.col("window")
    if total <= limit:
        # the empty word closes every document; its row carries the number of words, so that texts are read once
        closing = docs.sparkSession.range(1).select(
            F.lit("").alias("word"), F.lit(0).alias("offset"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("window")
        )
        ended = split.withColumn("n_words", F.size("words")).withColumn("words", F.array_append("words", F.lit("")))
        probed = ended.select("doc_id", "mark", "n_words", "words", F.posexplode("words").alias("at", "word"))
        found = probed.join(F.broadcast(prefixes.unionByName(closing)), "word").withColumn("start", start)
        kept = found.where(F.col("window").isNull() | (fits & same))
        return kept.select("doc_id", "mark", "n_words", "start", "n", "window")
    placed = split.select("doc_id", "mark", F.size("words").alias("n_words"), F.posexplode("words").alias("at", "word"))
    candidates = placed.join(prefixes, "word").withColumn("start", start).where(fits)
    wanted = candidates.select("doc_id", "mark", "n_words", "start", "n", "window").distinct()
    texts = split.dropDuplicates(["doc_id", "mark"]).withColumnsRenamed({"doc_id": "__doc", "mark": "__mark"})
    met = wanted.join(texts, wanted["doc_id"].eqNullSafe(texts["__doc"]) & (F.col("mark") == F.col("__mark")))
    verified = met.where(same).select("doc_id", "mark", "n_words", "start", "n", "window")
    none = F.lit(None)
    ends = split.select(
        "doc_id", "mark", F.size("words").alias("n_words"), none.cast("int").alias("start"), F.lit(0).alias("n"),
        none.cast("string").alias("window"),
    )
    return verified.unionByName(ends)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    limit: int = SMALL_ROWS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(doc_id, mark, n_words, n_hit, items, contaminated), one row per row of ``docs``."""
    hits = window_hits(docs, benchmark, width, limit, id_column, text_column)
    items = cut(item_windows(benchmark, width).withColumnRenamed("window", "__window"))
    met = hits.join(items, F.col("window") == F.col("__window"), "left")
    place = F.when(F.col("window").isNotNull(), F.struct("start", "n"))
    # a row of the document meets no item, so its closing rows are counted as they are
    rows = F.sum(F.when(F.col("window").isNull(), 1).otherwise(0)).cast("int")
    grouped = met.groupBy("doc_id", "mark", "n_words").agg(
        F.collect_set(place).alias("places"), F.collect_set("item_id").alias("items"), rows.alias("__rows")
    )
    spans = F.transform("places", lambda p: F.sequence(p["start"], p["start"] + p["n"] - 1))
    counted = grouped.select(
        "doc_id",
        "mark",
        F.col("n_words").cast("long").alias("n_words"),
        F.size(F.array_distinct(F.flatten(spans))).cast("long").alias("n_hit"),
        "items",
        F.explode(F.array_repeat(F.lit(1), F.col("__rows"))).alias("__copy"),
    )
    return counted.drop("__copy").withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: float = 0.0, limit: int = SMALL_ROWS) -> DataFrame:
    """Documents whose words in hits are at most ``share`` of all their words; columns as they came."""
    bad = contamination(docs, benchmark, width, limit).where(F.col("n_hit") > F.lit(share) * F.col("n_words"))
    keys = bad.select("doc_id", "mark").distinct()
    # the row travels as one value, so that its columns may have any names
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("mark"))
    return packed.join(keys, same, "left_anti").select("row.*")
