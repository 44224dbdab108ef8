"""Line deduplication by a log-template tree.

A line goes down a tree of fixed depth: its number of tokens, then its leading tokens, tokens with a digit being a
variable field. Under the leaf, lines are one template if they agree in all tokens, or in all but one of ``PARTS`` equal
stretches of the tail, which then is a variable field as well (lines of ``LONG`` tokens and more). A template recurs if it
stands in two distinct documents, or in ``min_times_short`` distinct ones if it is short: under ``LONG`` tokens and, for
scripts without blanks, under ``LONG_CHARS`` characters. Of a recurring template the first line in the document with the
smallest id stays and all others are dropped, those of the same document too, so every dropped line has an earlier one of
its kind.

Templates travel as hashes of token count and tokens; only the final join moves texts. A first count by 64-bit hashes sorts
out the lines that cannot recur; what is left is counted by 128 bits, so that no line is dropped for a hash it shares with
another. Nulls and odd rows: null and empty texts have no lines and come back as they are; a line without tokens is never
judged; a line repeated within one document only is not one that recurs across documents; rows that repeat an id count as
one document; a null id stands for a document of its own, ordered by a hash of its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ratingloom.llm.store import cut

DEPTH = 3
PARTS = 4
LONG = 8
_CHECK = 1_000_003
LONG_CHARS = 48
MIN_TIMES_SHORT = 5
MIN_TOKENS = 1

_SPACE = r"[\x20\x09\x0B-\x0D]+"
_FIELD = r"[^\x20\x09\x0B-\x0D]*[0-9][^\x20\x09\x0B-\x0D]*"


def line_tokens(line: Column) -> Column:
    """Tokens of a line, those with a digit generalised. Most lines have neither digits nor other space than blanks."""
    plain = ~line.rlike(r"[0-9\x09\x0B-\x0D]")
    tokens = F.when(plain, F.split(line, " ")).otherwise(F.split(F.regexp_replace(line, _FIELD, "<*>"), _SPACE))
    return F.array_remove(tokens, "")


def stretch_hashes(tokens: Column, depth: int, parts: int, seed: int) -> list[Column]:
    """Hashes of the leading tokens and of each stretch of the tail; where stretches begin depends on the token count."""
    n = F.size(tokens)
    step = F.greatest(F.ceil((n - depth) / F.lit(parts)).cast("int"), F.lit(0))
    head = F.slice(tokens, F.lit(1), F.lit(depth))
    return [F.xxhash64(F.lit(seed), s) for s in (head, *(F.slice(tokens, depth + 1 + p * step, step) for p in range(parts)))]


def template_keys(hashes: list[Column], n: Column, long: int, least: int, check: list[Column] | None = None) -> Column:
    """A hash of each template a line may belong to: all stretches first, then each one of the tail left open; with
    ``check``, hashes of another seed, a struct of both."""

    def key(of: list[Column], part: int) -> Column:
        return F.xxhash64(F.lit(part), n, *(h for at, h in enumerate(of) if part < 0 or at != part + 1))

    def keys(part: int) -> Column:
        return F.struct(key(hashes, part).alias("key"), key(check, part).alias("check")) if check else key(hashes, part)

    whole = keys(-1)
    return F.when(n >= long, F.array(whole, *map(keys, range(len(hashes) - 1)))).when(n >= least, F.array(whole))


def dropped_lines(docs: DataFrame, min_times_short: int, min_tokens: int, depth: int, parts: int, long: int) -> DataFrame:
    """(row, places): positions of the lines to drop, ascending, per document."""
    row = F.xxhash64("doc_id", "text")
    lines = docs.select(row.alias("row"), "doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    tokens = F.col("tokens")

    def keyed(check: bool) -> DataFrame:
        hashes = [h.alias(f"h{i}") for i, h in enumerate(stretch_hashes(tokens, depth, parts, 0))]
        others = [h.alias(f"o{i}") for i, h in enumerate(stretch_hashes(tokens, depth, parts, _CHECK))] if check else []
        by_chars = F.char_length(F.array_join(tokens, " ")) >= LONG_CHARS
        # a line that is too short has no keys; a filter on the tokens would have them computed twice
        hashed = lines.withColumn("tokens", line_tokens(F.col("line"))).select(
            "row",
            F.coalesce("doc_id", "row").alias("doc"),
            "place",
            F.size(tokens).alias("n"),
            F.when(F.size(tokens) >= long, F.lit(True)).otherwise(by_chars).alias("long"),
            *hashes,
            *others,
        )
        named = [[F.col(f"{letter}{i}") for i in range(parts + 1)] for letter in "ho"]
        keys = template_keys(named[0], F.col("n"), long, min_tokens, named[1] if check else None)
        made = hashed.select("row", "doc", "place", "long", F.explode(keys).alias("key"))
        return made.select("row", "doc", "place", "long", "key.key", "key.check") if check else made

    counted = keyed(False).groupBy("key").agg(
        F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("times"), F.max("long").alias("long")
    )
    # only a necessary condition, which sorts out most lines before documents are counted
    recurs = (F.col("first") < F.col("last")) & (F.col("long") | (F.col("times") >= min_times_short))
    met = cut(keyed(True).join(counted.where(recurs).select("key"), "key"))
    template = ["key", "check"]
    by_doc = met.groupBy(*template, "doc").agg(F.min(F.struct("row", "place")).alias("at"), F.max("long").alias("long"))
    needed = F.when(F.max("long"), F.lit(2)).otherwise(F.lit(min_times_short))
    templates = by_doc.groupBy(*template).agg(
        (F.count(F.lit(1)) >= needed).alias("recurs"), F.min(F.struct("doc", "at")).getField("at").alias("at")
    )
    kept = templates.where("recurs").select(*template, "at")
    later = met.join(kept, template).where(F.struct("row", "place") != F.col("at"))
    return later.groupBy("row").agg(F.array_sort(F.collect_set("place")).alias("places"))


def _kept(lines: Column, places: Column) -> Column:
    """The lines without those at ``places``, as the stretches between them; linear in both."""

    def stretch(k: Column) -> Column:
        begin = F.when(k == 0, F.lit(0)).otherwise(F.get(places, k - 1) + 1)
        end = F.coalesce(F.get(places, k), F.size(lines))
        return F.slice(lines, begin + 1, end - begin)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(places)), stretch))


def drop_recurring_lines(
    docs: DataFrame,
    min_times_short: int = MIN_TIMES_SHORT,
    min_tokens: int = MIN_TOKENS,
    depth: int = DEPTH,
    parts: int = PARTS,
    long: int = LONG,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``docs`` with the kept lines as text and the columns ``n_lines`` and ``n_dropped``, in place of any of that name."""
    packed = docs.select(F.struct("*").alias("__all"), F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    found = dropped_lines(packed.select("doc_id", "text"), min_times_short, min_tokens, depth, parts, long)
    marked = packed.withColumn("__row", F.xxhash64("doc_id", "text"))
    joined = marked.join(found, F.col("__row") == F.col("row"), "left")
    lines = F.split("text", "\n")
    # one element, so that the text is split once
    left = F.get(F.transform(F.array(lines), lambda whole: F.array_join(_kept(whole, F.col("places")), "\n")), F.lit(0))
    text = F.when(F.col("places").isNull(), F.col("text")).otherwise(left)
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(
        *[text.alias(c) if c == text_column else F.col("__all").getField(c).alias(c) for c in others],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
    )
