"""Nearest neighbours by a few stable projections, a kd-tree and a chi-square stopping test.

Vectors are projected on ``m`` random Gaussian directions. Under the 2-stable law the squared projected distance of two
vectors is their squared distance times a chi-square variable of ``m`` degrees. Candidates are verified in ascending
projected distance r; once P(chi-square <= r^2 / d^2) reaches ``stop`` for the current k-th true distance d, a nearer
vector would already have shown up with that probability and the search ends.

The tree has two layers. Its top, cut at medians of a bounded sample of projections, deals all rows into cells, one task
each; inside a cell a kd-tree of small buckets is walked nearest bucket first. A query is searched in its own cell first.
The distance found there, put into the test, gives the radius beyond which cells need no visit, and it is sent to the cells
nearer than that; ``block`` queries of a cell are one group of rows, so groups stay bounded however many queries there are.

Equal vectors are one entry with its ``k + 1`` smallest ids, kept by a limit before the shuffle, so copies never pile up.
Nulls and odd rows: vectors that are null, zero, hold null or non-finite parts, or have not the most common length take
no part, as query or as candidate; repeated rows of one id count once; ties go to the smaller id; with fewer candidates
than ``k`` all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ratingloom.llm.store import cut, on_workers, with_small

K = 10
PROJECTIONS = 20
STOP = 0.90
SAMPLE = 20_000
CELL_ROWS = 25_000
BLOCK = 512
BUCKET = 256
SEED = 7


def directions(dims: int, m: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims, m))


def chi_square_cdf(x: np.ndarray | float, m: int) -> np.ndarray | float:
    """P(chi-square of an even number of degrees <= x)."""
    half, term, total = np.asarray(x, float) / 2, 1.0, 1.0
    for i in range(1, m // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-np.minimum(half, 700)) * total


def stop_ratio(stop: float, m: int) -> float:
    """The x at which the distribution reaches ``stop``; the test holds once r^2 >= x * d^2."""
    low, high = 0.0, 10.0 * m + 100
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, m) < stop else (low, mid)
    return high


# --- the kd-tree -------------------------------------------------------------------------------------


def split_tree(points: np.ndarray, leaf: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Leaves as row numbers with their bounding boxes, halving the widest side at its median."""
    leaves, waiting = [], [np.arange(len(points))]
    while waiting:
        rows = waiting.pop()
        spread = np.ptp(points[rows], axis=0) if len(rows) else np.zeros(points.shape[1])
        if len(rows) <= leaf or not spread.max() > 0:
            leaves.append(rows)
            continue
        order = rows[np.argsort(points[rows, spread.argmax()], kind="stable")]
        waiting += [order[: len(order) // 2], order[len(order) // 2 :]]
    low = np.array([points[r].min(0) if len(r) else points[0] for r in leaves])
    high = np.array([points[r].max(0) if len(r) else points[0] for r in leaves])
    return leaves, low, high


def top_cuts(sample: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """Inner nodes of the top tree as (side, value) in heap order, cut at sample medians."""
    cuts: list[tuple[int, float]] = []
    level = [sample]
    while len(level) < cells:
        below = []
        for rows in level:
            side = int(np.var(rows, axis=0).argmax()) if len(rows) else 0
            value = float(np.median(rows[:, side])) if len(rows) else 0.0
            cuts.append((side, value))
            below += [rows[rows[:, side] < value], rows[rows[:, side] >= value]]
        level = below
    return cuts


def cell_of(points: np.ndarray, cuts: list[tuple[int, float]]) -> np.ndarray:
    node = np.zeros(len(points), int)
    if cuts:
        side, value = (np.array(v) for v in zip(*cuts, strict=True))
        for _ in range(int(math.log2(len(cuts) + 1))):
            node = 2 * node + 1 + (points[np.arange(len(points)), side[node]] >= value[node])
    return node - len(cuts)


def cell_boxes(cuts: list[tuple[int, float]], m: int) -> tuple[np.ndarray, np.ndarray]:
    """Low and high corner of every cell of the top tree."""
    low, high = [np.full(m, -np.inf)], [np.full(m, np.inf)]
    first = 0
    while first < len(cuts):
        next_low, next_high = [], []
        for k, (lo, hi) in enumerate(zip(low, high, strict=True)):
            side, value = cuts[first + k]
            left, right = hi.copy(), lo.copy()
            left[side], right[side] = min(hi[side], value), max(lo[side], value)
            next_low += [lo, right]
            next_high += [left, hi]
        first += len(low)
        low, high = next_low, next_high
    return np.array(low), np.array(high)


def box_gap(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of a point to each box."""
    away = np.maximum(np.maximum(low - point, point - high), 0)
    return (away * away).sum(1)


class Cell:
    """A kd-tree over the projections of some vectors, searched in ascending projected distance."""

    def __init__(self, vectors: np.ndarray, projected: np.ndarray, ids: list, bucket: int = BUCKET):
        self.vectors, self.projected, self.ids = vectors, projected, ids
        self.leaves, self.low, self.high = split_tree(projected, bucket)

    def search(self, vector: np.ndarray, point: np.ndarray, k: int, ratio: float, bound: float) -> list[tuple[float, int]]:
        """The ``k`` best (distance, id) found before the test holds; ``bound``: k-th squared distance known so far."""
        best: list[tuple[float, int]] = []
        gaps = box_gap(point, self.low, self.high)
        order = np.argsort(gaps, kind="stable")
        pending_rows, pending_gap = np.empty(0, int), np.empty(0)
        for at, leaf in enumerate(order):
            rows = self.leaves[leaf]
            near = ((self.projected[rows] - point) ** 2).sum(1)
            pending_rows, pending_gap = np.concatenate([pending_rows, rows]), np.concatenate([pending_gap, near])
            # rows nearer than the next bucket are the next neighbours in projected order
            edge = gaps[order[at + 1]] if at + 1 < len(order) else np.inf
            ready = pending_gap <= edge
            wanted = ready & ((pending_gap < ratio * bound) | (pending_gap == 0))
            if wanted.any():
                found = pending_rows[wanted]
                apart = self.vectors[found] - vector
                true = np.sqrt((apart * apart).sum(1))
                limit = math.sqrt(bound)
                best += [(float(d), i) for d, r in zip(true, found, strict=True) if d <= limit for i in self.ids[r]]
                best = sorted(best)[:k]
                if len(best) == k:
                    bound = min(bound, best[-1][0] ** 2 * (1 + 1e-12))
            pending_rows, pending_gap = pending_rows[~ready], pending_gap[~ready]
            if edge > 0 and edge >= ratio * bound:
                break
        return best


# --- on Spark ----------------------------------------------------------------------------------------


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 0))


def _distinct(vectors: DataFrame, k: int) -> DataFrame:
    """(entry, v, ids): equal vectors as one row with their ``k + 1`` smallest ids."""
    in_group = Window.partitionBy("v").orderBy("id")
    ranked = vectors.distinct().withColumn("__n", F.row_number().over(in_group)).where(F.col("__n") <= k + 1)
    grouped = ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return grouped.select(F.col("ids")[0].alias("entry"), "v", "ids")


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = K,
    m: int = PROJECTIONS,
    stop: float = STOP,
    sample: int = SAMPLE,
    cell_rows: int = CELL_ROWS,
    block: int = BLOCK,
    seed: int = SEED,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row that satisfies ``queries``.

    ``m`` must be even. The sample only places the cuts of the top tree; every row is indexed.
    """
    spark = vectors.sparkSession
    on_workers(spark)
    named = vectors.withColumn("__query", queries).select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"), F.col("__query").alias("is_query")
    )
    clean = named.where(usable(F.col("v")) & F.col("id").isNotNull())
    lengths = clean.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if lengths is None:
        return empty
    clean = clean.where(F.size("v") == lengths["dims"])
    stored = cut(_distinct(clean.select("id", "v"), k))
    rows = stored.count()
    plane = directions(lengths["dims"], m, seed)
    cells = 2 ** max(0, math.ceil(math.log2(max(rows, 1) / cell_rows)))
    picked = stored.select("v", "entry").orderBy(F.xxhash64("entry")).limit(min(sample, 200 * cells)).select("v").collect() if cells > 1 else []
    cuts = top_cuts(np.array([r["v"] for r in picked]) @ plane, cells) if cells > 1 else []
    low, high = cell_boxes(cuts, m)
    ratio = stop_ratio(stop, m)

    @F.pandas_udf("int")
    def home(column: pd.Series) -> pd.Series:
        return pd.Series(cell_of(_matrix(column) @ plane, cuts), dtype="int32") if len(column) else pd.Series([], dtype="int32")

    @F.pandas_udf("array<int>")
    def to_visit(column: pd.Series, known: pd.Series) -> pd.Series:
        # other cells nearer than the radius at which the test would hold
        out = []
        for vector, bound in zip(_matrix(column), known, strict=True):
            point = vector @ plane
            gaps = box_gap(point, low, high)
            near = gaps < ratio * (bound if bound == bound else math.inf)
            near[cell_of(point[None], cuts)[0]] = False
            out.append(np.flatnonzero(near).tolist())
        return pd.Series(out, dtype=object)

    indexed = stored.withColumn("cell", home("v"))
    wanted = clean.where("is_query").select("v").distinct().join(stored, "v").select("entry", "v")
    asked = cut(wanted.withColumn("cell", home("v")).withColumn("bound", F.lit(float("inf"))))

    def searched(pieces: DataFrame) -> DataFrame:
        """(entry, found<d, id>) for rows (entry, v, cell, bound): each block of a cell's queries meets the cell's rows."""
        counts = cut(pieces.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks")))
        place = F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int")
        dealt = with_small(pieces, counts, ["cell"]).withColumn("block", place)
        copies = with_small(indexed, counts, ["cell"]).select(
            F.col("cell").alias("at"),
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"),
            F.col("v").alias("data"),
            F.col("ids").alias("held"),
        )

        def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = {"entry": [], "found": []}
            if len(left) and len(right):
                data, ids = _matrix(right["data"]), [list(i) for i in right["held"]]
                cell = Cell(data, data @ plane, ids)
                for entry, vector, bound in zip(left["entry"], _matrix(left["v"]), left["bound"], strict=True):
                    hits = cell.search(vector, vector @ plane, k + 1, ratio, bound)
                    out["entry"].append(entry)
                    out["found"].append([{"d": d, "id": i} for d, i in hits])
            return pd.DataFrame(out)

        schema = "entry long, found array<struct<d:double,id:long>>"
        return dealt.groupBy("cell", "block").cogroup(copies.groupBy("at", "part")).applyInPandas(one, schema)

    first = cut(searched(asked))
    kth = F.element_at("found", k + 1)["d"]
    bound = F.when(F.size("found") >= k + 1, F.pow(kth, 2) * (1 + 1e-12)).otherwise(F.lit(float("inf")))
    if cells > 1:
        known = asked.drop("bound").join(first.select("entry", bound.alias("bound")), "entry")
        pieces = cut(known.select("entry", "v", F.explode(to_visit("v", "bound")).alias("cell"), "bound"))
        first = first.unionByName(searched(pieces))
    merged = first.groupBy("entry").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    # every query id of an entry takes the entry's neighbours but itself
    ids = clean.where("is_query").select("id", "v").distinct().join(stored.select("v", "entry"), "v").select("id", "entry")
    own = ids.join(merged, "entry").select("id", F.filter("found", lambda x: x["id"] != F.col("id")).alias("found"))
    listed = own.select(F.col("id").alias("query_id"), F.posexplode(F.slice("found", 1, k)).alias("at", "hit"))
    return listed.select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.d").alias("score")
    )
