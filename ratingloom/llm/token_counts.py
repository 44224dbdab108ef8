"""Token counts of whole texts by a map-side two-tier lookup of pre-token lengths.

Under a piece model whose pieces never cross a space or a line feed, a text's tokens are the tokens of its pre-tokens: a
run of spaces with what follows, or a line feed with what follows. Tier one is a broadcast table of the lengths of the
most frequent pre-tokens, found by mergeable top-k sketches over all documents (``frequent`` entries of at most
``LONGEST`` characters, so its size is bounded). Tier two is a cache in each Python worker; what neither has is encoded by
the library, one pre-token at a time. Only sketches cross the network, never pre-tokens, and texts stay where they are.

Nulls and odd rows: a null text is empty and has 0 bytes and 0 tokens; repeated rows are each counted; an empty table
gives an empty result; very long pre-tokens are encoded but not kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ratingloom.llm.store import on_workers

LIMIT = 4096
FREQUENT = 16_384
LONGEST = 32
CACHED = 400_000
_SKETCHES = 64

_MARK = "▁"
_PRETOKEN = re.compile(f"[ {_MARK}]+[^ {_MARK}\n]*|\n[^ {_MARK}\n]*")


class PretokenCounter:
    """Counts tokens of texts in one process; ``known`` is the first tier."""

    def __init__(self, path: str, known: dict[str, int] | None = None, cached: int = CACHED):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known, self.cached, self.cache = known or {}, cached, {}
        self._verify()

    def _verify(self) -> None:
        """The model must keep spaces and line feeds apart from what stands before them."""
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        crossing = [p for p in pieces if "\n" in p or _MARK in p.lstrip(_MARK)]
        probe = " a  b\n\nc "
        if crossing or self.count(probe) != len(self.model.encode(probe)):
            raise ValueError("pre-token lengths do not add up under this model")

    def length(self, pretoken: str) -> int:
        """Tokens of one pre-token; the library puts a space before whatever it encodes."""
        if pretoken[0] == "\n":
            return len(self.model.encode(pretoken)) - 1
        return len(self.model.encode(pretoken[1:])) if len(pretoken) > 1 else 1

    def _miss(self, pretoken: str) -> int:
        found = self.length(pretoken)
        if len(pretoken) <= LONGEST:
            if len(self.cache) >= self.cached:
                self.cache.clear()
            self.cache[pretoken] = found
        return found

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known, cache, total = self.known, self.cache, 0
        for pretoken in _PRETOKEN.findall(" " + text):
            found = known.get(pretoken)
            if found is None:
                found = cache.get(pretoken)
                if found is None:
                    found = self._miss(pretoken)
            total += found
        return total


# one counter per worker process and model; caches outlive a task
_COUNTERS: dict[str, PretokenCounter] = {}


def frequent_pretokens(docs: DataFrame, frequent: int = FREQUENT, text_column: str = "text") -> DataFrame:
    """(pretoken): at most ``frequent`` words with the space before them, from sketches over all texts."""
    words = docs.select(F.explode(F.split(text_column, " ")).alias("word"), (F.spark_partition_id() % _SKETCHES).alias("part"))
    short = words.where((F.length("word") > 0) & (F.length("word") < LONGEST) & ~F.contains("word", F.lit("\n")))
    top = F.call_function("approx_top_k", F.col("word"), F.lit(frequent), F.lit(4 * frequent))
    sketched = short.groupBy("part").agg(top.alias("top")).select(F.inline("top"))
    merged = sketched.groupBy("item").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "item").limit(frequent)
    return merged.select(F.concat(F.lit(" "), "item").alias("pretoken"))


def token_counts(
    docs: DataFrame,
    model_path: str,
    limit: int = LIMIT,
    frequent: int = FREQUENT,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row of ``docs``; every node must have the model at its path."""
    on_workers(docs.sparkSession)
    counter = PretokenCounter(model_path)
    known = {}
    for (pretoken,) in frequent_pretokens(docs, frequent, text_column).collect():
        if _PRETOKEN.fullmatch(pretoken):
            known[pretoken] = counter.length(pretoken)
    first_tier = docs.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _COUNTERS.get(model_path)
        if counter is None:
            counter = _COUNTERS[model_path] = PretokenCounter(model_path)
        counter.known = first_tier.value
        for texts in batches:
            yield pd.Series([counter.count(text) for text in texts], dtype="int64")

    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(
        F.col(id_column).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), counted(text).alias("n_tokens")
    ).withColumn("over_limit", F.col("n_tokens") > limit)
