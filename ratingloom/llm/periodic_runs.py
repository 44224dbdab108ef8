"""Runs of periodic word repetition in a text, by an online sparse diagonal DP.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that is at least ``LEAST``
words and ``TIMES`` periods long and that no neighbouring word extends. The DP follows diagonals: a word that equals the
one q places before lengthens the match of lag q by one; a diagonal whose next word does not match has ended, and if it is
long enough its run is emitted there and then.

The table is sparse. A lag q is followed at one scale only, the power of two k with k/2 < q <= k (8 for the smallest), and
a word counts as an earlier occurrence only if the k words that end there are the same, of which only the nearest one is
looked at. Nothing is lost by that: a run of TIMES >= 3 periods matches at least 2q >= k words at lag q, and a nearer
occurrence of the same k >= q words inside the run would give the whole run a smaller period. So at most one lag is active
at each scale, and a text of n words takes O(n log n) steps even where one word or one phrase fills it. A text without any
repeated sequence of 8 words has no run and is not followed at all; equal sequences are told by hashes there and by exact
names (pairs of names of half the size) everywhere else.

Nulls and odd rows: a null or empty text has no words, no runs and an empty collapsed text; runs may overlap, each is
reported; rows that repeat an id are each answered; an empty table gives an empty result. A text is one row and must fit
in a task; nothing else is gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ratingloom.llm.store import on_workers
from ratingloom.llm.words import mixed

LEAST = 24
TIMES = 3
SCALE = 8

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUNS = "array<struct<start:long,length:long,period:long>>"


def _numbered(words: list[str]) -> np.ndarray:
    names: dict[str, int] = {}
    return np.array([names.setdefault(w, len(names)) for w in words], np.int64)


def _repeats_anything(numbers: np.ndarray) -> bool:
    """Whether some sequence of ``SCALE`` words may stand twice; equal hashes may deceive, unequal ones do not."""
    hashed, width = mixed(numbers.astype(np.uint64) + np.uint64(1)), 1
    while width < SCALE:
        hashed = mixed(hashed[:-width] * np.uint64(0x9E3779B97F4A7C15) + hashed[width:])
        width *= 2
    ranked = np.sort(hashed)
    return bool((ranked[1:] == ranked[:-1]).any())


def _doubled(names: np.ndarray, width: int) -> np.ndarray:
    """Names of sequences twice as long: equal names mean equal sequences."""
    pairs = names[:-width] * (names.max() + 1) + names[width:]
    return np.unique(pairs, return_inverse=True)[1]


def _nearest(names: np.ndarray) -> np.ndarray:
    """Distance from each place to the nearest earlier one of the same name; 0 without one."""
    order = np.argsort(names, kind="stable")
    ranked, lag = names[order], np.zeros(len(names), np.int64)
    again = np.flatnonzero(ranked[1:] == ranked[:-1]) + 1
    lag[order[again]] = order[again] - order[again - 1]
    return lag


def _diagonals(lag: np.ndarray, width: int) -> Iterator[tuple[int, int, int]]:
    """(begin, matched, lag) of every diagonal as it ends; ``matched`` words from ``begin`` equal those ``lag`` before."""
    fits = (lag > 0) & (lag <= width)
    if width > SCALE:
        fits &= 2 * lag > width
    places = np.flatnonzero(fits)
    active = matched = begin = after = 0
    for place, found in zip(places.tolist(), lag[places].tolist(), strict=True):
        if found == active and place == after:
            matched += 1
        else:
            if active:
                yield begin, matched, active
            active, matched, begin = found, width, place
        after = place + 1
    if active:
        yield begin, matched, active


def find_runs(words: list[str], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period. ``least`` is at least 16 words, ``times`` at least 3."""
    if least < 2 * SCALE or times < 3:
        raise ValueError("shorter runs would be missed")
    n, found = len(words), []
    if n < least:
        return found
    names = _numbered(words)
    if not _repeats_anything(names):
        return found
    width = 1
    while width < SCALE:
        names = _doubled(names, width)
        width *= 2
    while True:
        lag = _nearest(names)
        if not lag.any():
            break
        for begin, matched, period in _diagonals(lag, width):
            if matched + period >= max(least, times * period):
                found.append((begin - period, matched + period, period))
        # the smallest lag of the next scale needs so many words
        if times * (width + 1) > n or n < 2 * width:
            break
        names = _doubled(names, width)
        width *= 2
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without what a run repeats after its first period."""
    if not runs:
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    kept = np.cumsum(steps[:-1]) == 0
    return [w for w, keep in zip(words, kept.tolist(), strict=True) if keep]


def periodic_runs(
    docs: DataFrame, least: int = LEAST, times: int = TIMES, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, n_words, runs<start, length, period>, collapsed), one row per row of ``docs``; the collapsed text has its
    kept words joined by one blank. Texts are answered where they are read, nothing is shuffled."""
    on_workers(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, kept = [], [], []
            for text in batch.column(1):
                words = _WORD.findall(text.as_py() or "")
                found = find_runs(words, least, times)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                kept.append(" ".join(collapse(words, found)))
            columns = [pa.array(counts, pa.int64()), pa.array(runs, pa.list_(run)), pa.array(kept, pa.string())]
            yield pa.record_batch([batch.column(0), *columns], ["doc_id", "n_words", "runs", "collapsed"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(followed, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")


def most_periodic(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; ties to the smaller start, then period; null without a
    run. ``runs`` come by start and period, so the first of equals is the one wanted."""
    none = F.lit(None).cast(RUNS[len("array<") : -1])

    def better(best: Column, run: Column) -> Column:
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    return F.aggregate(runs, none, better)
