"""Near duplicates by b-bit MinHash, links confirmed on full shingle sets.

A document is the set of its distinct ``shingle``-word shingles. Documents with equal sets are one class, named by the
smallest id. Each class has ``bands * rows`` minima; bands of ``rows`` minima make the candidates, and the low ``bits`` of
all minima, packed, estimate similarity: the share of equal groups of bits, counted on the XOR of two signatures and
corrected for chance collisions. Classes that meet in a band, directly or through others, form a family. Families are cut
into blocks of bounded shingle count and every pair of blocks is one group: pairs that the estimate leaves open and that
are not yet connected are confirmed on full sets, and the group returns one row per member, not per pair. The components
of those rows are the result. Bands have no cap.

A pair at the threshold misses all bands with probability (1 - 0.85^4)^32 < 1e-10, and fails the estimate, set
``MARGIN`` standard deviations low, with less than 1e-6.

Nulls and odd rows: null and wordless texts have empty sets and link with nothing; with fewer words than a shingle the
whole sequence is the one shingle; repeated rows are copies of each other; a null id links with nothing and is kept; an
id that comes with several texts is one document with all their links; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from ratingloom.llm.components import components
from ratingloom.llm.store import cut, on_workers
from ratingloom.llm.words import lower_words, mixed, word_hashes

SHINGLE = 5
PERCENT = 80
BANDS = 32
ROWS = 4
BITS = 4
MARGIN = 5.0
BLOCK_SHINGLES = 400_000
SEED = 99


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = lower_words(text)
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    width = min(shingle, len(words))
    rolled = np.full(len(words) - width + 1, width, np.uint64)
    for at in range(width):
        rolled = mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[at : len(words) - width + 1 + at])
    return np.unique(rolled)


def minima(values: np.ndarray, count: int, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    times = rng.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 2**63, count, dtype=np.uint64)
    least = np.full(count, np.iinfo(np.uint64).max)
    for at in range(0, len(values), 2048):
        least = np.minimum(least, (values[at : at + 2048, None] * times + plus).min(0))
    return least


def packed_bits(least: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of scrambled minima, ``64 // bits`` to a word."""
    low = mixed(least) & np.uint64((1 << bits) - 1)
    grouped = low.reshape(-1, 64 // bits) << (np.arange(64 // bits, dtype=np.uint64) * np.uint64(bits))
    return np.bitwise_or.reduce(grouped, axis=1)


def estimated(one: np.ndarray, many: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Collision-corrected similarity of a packed signature with each of many."""
    differs = many ^ one
    folded = differs.copy()
    for shift in range(1, bits):
        folded |= differs >> np.uint64(shift)
    lowest = np.uint64(sum(1 << at for at in range(0, 64, bits)))
    unequal = np.bitwise_count(folded & lowest).sum(-1)
    chance = 2.0**-bits
    return (1 - unequal / (one.shape[-1] * (64 // bits)) - chance) / (1 - chance)


def floor_estimate(percent: int, count: int, bits: int = BITS, margin: float = MARGIN) -> float:
    """The estimate below which a pair at the threshold falls with negligible probability."""
    chance, target = 2.0**-bits, percent / 100
    equal = target + (1 - target) * chance
    return target - margin * (equal * (1 - equal) / count) ** 0.5 / (1 - chance)


class Links:
    """Union-find over the members of a group."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = i = self.root[self.root[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        self.root[max(a, b)] = min(a, b)


def confirmed(sets: list[np.ndarray], packed: np.ndarray, side: np.ndarray, percent: int, bits: int, least: float) -> np.ndarray:
    """Root of each member: pairs across sides (within, if all sides are equal) whose full sets meet the threshold."""
    n, links = len(sets), Links(len(sets))
    sizes = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mask = np.zeros(codes.max() + 1, bool)
    within = (side == side[0]).all()
    for i in range(1, n):
        small, large = np.minimum(sizes[:i], sizes[i]), np.maximum(sizes[:i], sizes[i])
        open_ = 100 * small >= percent * large
        if not within:
            open_ &= side[:i] != side[i]
        others = np.flatnonzero(open_)
        if not len(others):
            continue
        others = others[estimated(packed[i], packed[others], bits) >= least]
        mine = links.find(i)
        others = [j for j in others.tolist() if links.find(j) != mine]
        if not others:
            continue
        own = codes[starts[i] : starts[i + 1]]
        mask[own] = True
        for j in others:
            if links.find(j) != links.find(i):
                shared = int(mask[codes[starts[j] : starts[j + 1]]].sum())
                if 100 * shared >= percent * (sizes[i] + sizes[j] - shared):
                    links.join(i, j)
        mask[own] = False
    return np.array([links.find(i) for i in range(n)])


def sketches(docs: DataFrame, shingle: int, bands: int, rows: int, bits: int) -> DataFrame:
    """(doc_id, n, digest, bands, packed) per row of (doc_id, text); digest, bands and packed are null for empty sets."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = mixed(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            out = {"doc_id": batch["doc_id"], "n": [], "digest": [], "bands": [], "packed": []}
            for text in batch["text"]:
                values = shingle_set(text, shingle)
                out["n"].append(len(values))
                if len(values):
                    least = minima(values, bands * rows)
                    keys = marks.copy()
                    for column in least.reshape(bands, rows).T:
                        keys = mixed(keys ^ column) * np.uint64(3) + np.uint64(1)
                    out["digest"].append(xxhash.xxh3_128_digest(values.tobytes()))
                    out["bands"].append(keys.view(np.int64))
                    out["packed"].append(packed_bits(least, bits).tobytes())
                else:
                    for name in ("digest", "bands", "packed"):
                        out[name].append(None)
            yield pd.DataFrame(out)

    # ids travel as text, since pandas has no long with nulls
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    made = named.mapInPandas(sketch, "doc_id string, n long, digest binary, bands array<long>, packed binary")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def _families(classes: DataFrame) -> DataFrame:
    """(node, root): classes that share a band with another, directly or through others."""
    keys = classes.select("rep", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead < last")
    edges = keys.join(shared.select("band", "lead"), "band").where("rep <> lead")
    return components(edges.select(F.col("rep").alias("u"), F.col("lead").alias("v")))


def _groups(members: DataFrame, block_shingles: int) -> DataFrame:
    """Members with ``bin``, ``block`` and the pair of blocks each copy belongs to."""
    sized = members.groupBy("family").agg(F.ceil(F.sum("n") / F.lit(block_shingles)).cast("int").alias("blocks"))
    total = members.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bins = max(1, total // block_shingles)
    placed = members.join(sized, "family")
    # families of one block share bins, so that thousands of pairs do not make thousands of groups
    bin_ = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("family"), F.lit(bins))).otherwise(-1 - F.abs(F.col("family")))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    with_block = placed.withColumn("bin", bin_).withColumn("block", block)
    partner = with_block.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return partner.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    bits: int = BITS,
    block_shingles: int = BLOCK_SHINGLES,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    Two documents are linked if 100 * |intersection| >= percent * |union|.
    """
    on_workers(docs.sparkSession)
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    sketched = cut(sketches(texts, shingle, bands, rows, bits))
    named = sketched.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = named.groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.min_by(F.struct("n", "bands", "packed"), "doc_id").alias("s")
    )
    classes = cut(classes.select("digest", "rep", "s.*"))
    families = cut(_families(classes))
    inside = classes.join(families, classes["rep"] == families["node"]).select(
        "rep", F.col("root").alias("family"), "n", "packed", "digest"
    )
    grouped = _groups(cut(inside), block_shingles)
    # an id with several texts is met by each of them; its classes carry the same name. Texts move once, by id
    wanted = families.select(F.col("node").alias("doc_id"))
    picked = texts.where("text is not null").join(wanted, "doc_id", "left_semi").distinct()
    with_text = grouped.join(picked, F.col("rep") == F.col("doc_id")).drop("doc_id")
    least = floor_estimate(percent, bands * rows, bits)

    def linked(group: pd.DataFrame) -> pd.DataFrame:
        ids, roots = [], []
        for _, family in group.sort_values(["family", "rep"]).groupby("family", sort=False):
            if len(family) < 2:
                continue
            sets = [shingle_set(t, shingle) for t in family["text"]]
            packed = np.array([np.frombuffer(p, np.uint64) for p in family["packed"]])
            root = confirmed(sets, packed, family["block"].to_numpy(), percent, bits, least)
            reps = family["rep"].to_numpy()
            ids += reps.tolist()
            roots += reps[root].tolist()
        return pd.DataFrame({"u": ids, "v": roots})

    links = with_text.groupBy("bin", "low", "high").applyInPandas(linked, "u long, v long")
    found = components(links)
    reps = classes.select("digest", "rep")
    met = sketched.join(reps, "digest", "left").join(found, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("root", "rep", "doc_id")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(component)
    return met.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with one document of each group as one row, columns as they came; see ``drop_repeats``."""
    found = near_duplicates(docs, **parameters)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"))
    return drop_repeats(packed.join(gone, F.col("id") == F.col("gone"), "left_anti").select("row.*"))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """One row for each (doc_id, text), columns as they came; null ids are told apart by their text alone.

    Rows that differ in other columns only are repeats, of which the one with the smallest hash of those columns stays.
    """
    others = F.xxhash64(F.to_json(F.struct(*[c for c in docs.columns if c != "text"])))
    packed = docs.select(F.struct("*").alias("row"), others.alias("order"), F.col("doc_id").alias("id"), F.md5("text").alias("digest"))
    return packed.groupBy("id", "digest").agg(F.min_by("row", "order").alias("row")).select("row.*")
