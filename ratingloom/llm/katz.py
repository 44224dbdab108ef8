"""Language-model scores by Katz backoff over counts of the whole training part.

The model is a bigram over words and one end per text, backing off to single words and from there to one class of unknown
words, whatever history or word lacks. Counts up to ``CUT`` are discounted by Good-Turing; the mass a history gives up is
spread over the words never seen after it by a weight that makes its probabilities sum to 1 exactly. A history that never
gave up mass (all its counts are large) reserves one event of its own.

How it runs: texts are read once and kept as chunks of bounded token count (a dictionary of the chunk and its token
numbers). Two exchanges follow, each as packed arrays from chunks to count tables and back:

1. Distinct words of a chunk go to the table part of their hash, which adds up training counts and answers with a global
   number and count per word. The number of the same word is the same for all chunks.
2. Distinct pairs of a chunk go to the table part of their history (of history and word, for histories above an even
   share), which answers with the count of each pair, whether a history gives up mass and, for histories with an unseen
   pair in the chunk, the statistics that the backoff weight needs. Those of split histories are added up over their parts
   and joined back to the chunks that have them.

So a token never travels, only what is distinct in a chunk, and every table part is bounded by ``PART_ENTRIES``.

Nulls and odd rows: a null or empty text is one end; repeated rows are scored and learned from each; a null id has no
checksum and is neither held out nor learned from; an empty training part gives every word to the unknown class. Row order
within an input partition should be repeatable, as it is for a table scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from ratingloom.llm.store import cut, on_workers
from ratingloom.llm.words import lower_words, mixed

CUT = 5
CHUNK_TOKENS = 2_000_000
PART_ENTRIES = 2_000_000
END = ""  # words are never empty
BOS = 0
UNKNOWN = np.uint64(2**64 - 1)


# --- packed arrays -----------------------------------------------------------------------------------


def packed(values: np.ndarray) -> bytes:
    """Whole or real numbers in the narrowest type, bytes of like place together, compressed."""
    values = np.ascontiguousarray(values)
    if values.dtype.kind in "iu":
        most = int(values.max()) if len(values) else 0
        values = values.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if most < 1 << (8 * int(t[2]))))
    planes = values.view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()
    return values.dtype.str.encode().ljust(4) + zstandard.compress(planes, 1)


def unpacked(blob: bytes) -> np.ndarray:
    kind = np.dtype(blob[:4].decode().strip())
    planes = np.frombuffer(zstandard.decompress(blob[4:]), np.uint8)
    values = np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel()
    return values if kind.kind == "f" else values.astype(np.uint64)


def packed_words(words: list[str]) -> bytes:
    return zstandard.compress("\n".join(words).encode(), 1)


def unpacked_words(blob: bytes) -> list[str]:
    return zstandard.decompress(blob).decode().split("\n")


# --- discounts ---------------------------------------------------------------------------------------


def good_turing(counts_of_counts: list[int], cut_at: int = CUT) -> np.ndarray:
    """Factors for counts 1..cut_at from the numbers of items seen 1..cut_at + 1 times.

    Where the numbers give no usable factors, counts lose a constant instead.
    """
    n = np.array([0, *counts_of_counts], float)
    r = np.arange(1, cut_at + 1)
    if (n[1 : cut_at + 2] > 0).all():
        tail = (cut_at + 1) * n[cut_at + 1] / n[1]
        factors = ((r + 1) * n[r + 1] / (n[r] * r) - tail) / (1 - tail) if tail != 1 else np.zeros(cut_at)
        if (factors > 0).all() and (factors < 1).all():
            return factors
    once, twice = n[1], n[2]
    less = once / (once + 2 * twice) if once and twice else 0.5
    return (r - less) / r


class Discounts:
    """Discounted counts: ``factor`` by count for small ones, 1 beyond."""

    def __init__(self, counts_of_counts: list[int]):
        self.factors = np.concatenate([[0.0], good_turing(counts_of_counts), [1.0]])

    def of(self, counts: np.ndarray) -> np.ndarray:
        return self.factors[np.minimum(counts, len(self.factors) - 1).astype(int)] * counts


class Words:
    """Probabilities of single words: discounted counts over all, the rest for the unknown class."""

    def __init__(self, tokens: int, counts_of_counts: list[int]):
        self.tokens, self.discounts = tokens, Discounts(counts_of_counts)
        given_up = sum(n * (r - self.discounts.of(np.array([r]))[0]) for r, n in enumerate(counts_of_counts[:CUT], 1))
        self.scale = 1 / tokens if given_up > 1e-9 else 1 / (tokens + 1)
        self.unknown = max(1 - (tokens - given_up) * self.scale, 0.0) if tokens else 1.0

    def probability(self, counts: np.ndarray) -> np.ndarray:
        known = self.discounts.of(counts) * self.scale if self.tokens else np.zeros(len(counts))
        return np.where(counts > 0, known, self.unknown)


# --- chunks ------------------------------------------------------------------------------------------

_CHUNK = "chunk long, ids binary, held binary, lengths binary, tokens binary, words binary, trained binary, n long"


class _Chunk:
    def __init__(self):
        self.number: dict[str, int] = {}
        self.docs, self.held, self.lengths, self.tokens = [], [], [], []

    def add(self, doc: int, held: int, words: list[str]) -> None:
        """``held``: 0 learned from, 1 held out, 2 neither."""
        number = self.number
        row = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint32, len(words))
        self.docs.append(doc)
        self.held.append(held)
        self.lengths.append(len(row))
        self.tokens.append(row)

    def row(self, part: int, seq: int) -> dict:
        tokens, lengths = np.concatenate(self.tokens), np.array(self.lengths)
        learned = np.repeat(np.array(self.held) == 0, lengths)
        trained = np.bincount(tokens[learned], minlength=len(self.number))
        ids = np.array(self.docs, np.int64)
        return {
            "chunk": xxhash.xxh3_64_intdigest(ids.tobytes() + bytes(f":{part}:{seq}", "ascii")) >> 1,
            "ids": ids.tobytes(),
            "held": packed(np.array(self.held)),
            "lengths": packed(lengths),
            "tokens": packed(tokens),
            "words": packed_words(list(self.number)),
            "trained": packed(trained),
            "n": len(self.number),
        }


def _chunks(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, seq, size = _Chunk(), 0, 0
        for batch in batches:
            for doc, part, held, text in zip(batch["doc_id"], batch["part"], batch["held"], batch["text"], strict=True):
                words = [*lower_words(text), END]
                chunk.add(doc, held, words)
                size += len(words)
                if size >= chunk_tokens:
                    yield pd.DataFrame([chunk.row(part, seq)])
                    chunk, seq, size = _Chunk(), seq + 1, 0
        if size:
            yield pd.DataFrame([chunk.row(part, seq)])

    return docs.withColumn("part", F.spark_partition_id()).mapInPandas(build, _CHUNK)


# --- exchange of words -------------------------------------------------------------------------------

_ANSWER = "chunk long, kind string, part long, first binary, second binary, third binary, fourth binary, stats array<long>, "
_ANSWER += f"split array<struct<h:long,{','.join(f'c{r}:long' for r in range(1, CUT + 1))},covered:double>>"
_COLUMNS = ["chunk", "kind", "part", "first", "second", "third", "fourth", "stats", "split"]


def _parts_of(words: list[str], parts: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64) % np.uint64(parts)


def _word_answers(chunks: DataFrame, parts: int) -> DataFrame:
    """Per chunk and part: global numbers and training counts of the chunk's words of that part, in the chunk's order."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, blob, trained in zip(batch["chunk"], batch["words"], batch["trained"], strict=True):
                words, counts = unpacked_words(blob), unpacked(trained)
                part = _parts_of(words, parts)
                out = []
                for p in np.unique(part).tolist():
                    at = np.flatnonzero(part == p)
                    out.append((p, chunk, packed_words([words[i] for i in at]), packed(counts[at])))
                yield pd.DataFrame(out, columns=["part", "chunk", "words", "counts"])

    def count(group: pd.DataFrame) -> pd.DataFrame:
        total: dict[str, int] = {}
        for blob, counts in zip(group["words"], group["counts"], strict=True):
            for word, n in zip(unpacked_words(blob), unpacked(counts).tolist(), strict=True):
                total[word] = total.get(word, 0) + n
        part = int(group["part"].iloc[0])
        known = sorted((w for w, n in total.items() if n), key=lambda w: (-total[w], w))
        number = {w: 1 + part + rank * parts for rank, w in enumerate(known)}
        counts = np.array([total[w] for w in known], np.int64)
        stats = [len(known), int(counts.sum()), *(int((counts == r).sum()) for r in range(1, CUT + 2))]
        out = []
        for chunk, blob in zip(group["chunk"], group["words"], strict=True):
            words = unpacked_words(blob)
            numbers = np.array([number.get(w, 0) for w in words], np.uint64)
            out.append((chunk, "words", part, packed(numbers), packed(np.array([total[w] for w in words])), None, None, None, None))
        # one row more says what the whole part holds
        out.append((-1, "total", part, None, None, None, None, stats, None))
        return pd.DataFrame(out, columns=_COLUMNS)

    sent = chunks.select("chunk", "words", "trained").mapInPandas(send, "part long, chunk long, words binary, counts binary")
    return sent.groupBy("part").applyInPandas(count, _ANSWER)


def _split_answers(answers: DataFrame) -> DataFrame:
    """Per chunk the whole statistics of the split histories that it has, added up over their parts."""
    sums = [F.sum(c).alias(c) for c in (*[f"c{r}" for r in range(1, CUT + 1)], "covered")]
    whole = answers.where("kind = 'split'").select(F.inline("split")).groupBy("h").agg(*sums)
    asked = answers.where("kind = 'asks'").select("chunk", F.explode("split.h").alias("h")).distinct()
    fields = F.struct("h", *[f"c{r}" for r in range(1, CUT + 1)], "covered")
    return asked.join(whole, "h").groupBy("chunk").agg(F.collect_list(fields).alias("split")).withColumn("kind", F.lit("split"))


def _totals(answers: DataFrame) -> list[int]:
    """Element sums of the statistics rows: one row per part, added up on Spark."""
    rows = answers.where("kind = 'total'").select(F.posexplode("stats").alias("at", "n"))
    return [r["n"] for r in rows.groupBy("at").agg(F.sum("n").alias("n")).orderBy("at").collect()]


# --- exchange of pairs -------------------------------------------------------------------------------


class _Pairs:
    """The distinct pairs of a chunk in the order in which they are sent, and where each token finds its pair."""

    def __init__(self, row: pd.Series, answers: pd.DataFrame, word_parts: int, pair_parts: int, tokens: int):
        words = unpacked_words(row["words"])
        part = _parts_of(words, word_parts)
        self.numbers, self.counts = np.zeros(len(words), np.uint64), np.zeros(len(words), np.int64)
        for p, first, second in zip(answers["part"], answers["first"], answers["second"], strict=True):
            at = np.flatnonzero(part == p)
            self.numbers[at], self.counts[at] = unpacked(first), unpacked(second)
        self.numbers[self.counts == 0] = UNKNOWN
        self.tokens = unpacked(row["tokens"]).astype(np.int64)
        self.lengths = unpacked(row["lengths"]).astype(np.int64)
        self.held = unpacked(row["held"])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        bos = len(words)
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = bos
        # the start of a text is a history seen once per learned text, as often as the end
        end = words.index(END)
        number, count = np.append(self.numbers, np.uint64(BOS)), np.append(self.counts, self.counts[end])
        keys, self.pair_of = np.unique((before << 32) | self.tokens, return_inverse=True)
        self.h, self.w = keys >> 32, keys & 0xFFFFFFFF
        learned = np.repeat(self.held == 0, self.lengths)
        trained = np.bincount(self.pair_of[learned], minlength=len(keys))
        h_number, w_number = number[self.h], self.numbers[self.w]
        self.h_count = count[self.h]
        # a history above an even share is split by word; at most ``8 * pair_parts`` pieces come of all splits
        pieces = np.minimum(1 + self.h_count // max(1, tokens // (4 * pair_parts)), pair_parts).astype(np.uint64)
        target = (mixed(h_number) + mixed(w_number) % pieces) % np.uint64(pair_parts)
        order = np.lexsort((w_number, h_number, target))
        # an unseen history has no counts to ask for, nor has an unknown word more than one pair with a history
        self.order = order[self.h_count[order] > 0]
        self.target, self.h_number, self.w_number = (a[self.order] for a in (target, h_number, w_number))
        self.trained, self.split = trained[self.order], pieces[self.order] > 1
        self.all_numbers = number

    def parts(self) -> Iterator[tuple[int, slice]]:
        bounds = np.flatnonzero(np.diff(self.target)) + 1
        for low, high in zip([0, *bounds], [*bounds, len(self.target)], strict=True):
            if high > low:
                yield int(self.target[low]), slice(low, high)


def _pair_answers(chunks: DataFrame, words: DataFrame, word_parts: int, pair_parts: int, model: Words) -> DataFrame:
    """Per chunk and part: counts of the chunk's pairs in sent order; statistics of histories with an unseen pair there."""

    def send(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in left.iterrows():
            pairs = _Pairs(row, right, word_parts, pair_parts, model.tokens)
            w_count = pairs.counts[pairs.w[pairs.order]]
            for part, at in pairs.parts():
                histories, first, follow = np.unique(pairs.h_number[at], return_index=True, return_counts=True)
                split = pairs.split[at][first]
                steps = np.diff(histories, prepend=np.uint64(0))
                w = np.where(pairs.w_number[at] == UNKNOWN, np.uint64(0), pairs.w_number[at])
                blobs = (steps, split, follow, w, w_count[at], pairs.trained[at])
                out.append((part, row["chunk"], *map(packed, blobs)))
        return pd.DataFrame(out, columns=["part", "chunk", "histories", "split", "follow", "w", "w_count", "trained"])

    def count(group: pd.DataFrame) -> pd.DataFrame:
        opened, split = [], []
        for r in group.itertuples():
            split.append(np.cumsum(unpacked(r.histories))[unpacked(r.split) > 0])
            follow = unpacked(r.follow).astype(np.int64)
            opened.append((np.repeat(np.cumsum(unpacked(r.histories)), follow), unpacked(r.w), unpacked(r.w_count), unpacked(r.trained)))
        h, w, w_count, trained = (np.concatenate(arrays) for arrays in zip(*opened, strict=True))
        sizes = [len(o[0]) for o in opened]
        h_all, h_code = np.unique(h, return_inverse=True)
        w_code = np.unique(w, return_inverse=True)[1]
        _, first, code = np.unique((h_code << 32) | w_code, return_index=True, return_inverse=True)
        total = np.bincount(code, weights=trained).astype(np.int64)
        counts = total[code]
        # statistics of each history: pairs seen 1..CUT times, and the word probability of all that was seen after it
        seen = total > 0
        owner, times = h_code[first][seen], total[seen]
        by_count = np.stack([np.bincount(owner[times == r], minlength=len(h_all)) for r in range(1, CUT + 1)])
        covered = np.bincount(owner, weights=model.probability(w_count[first][seen].astype(np.int64)), minlength=len(h_all))
        stats = [int((times == r).sum()) for r in range(1, CUT + 2)]
        out, begin = [], 0
        part = int(group["part"].iloc[0])
        shared = np.searchsorted(h_all, np.unique(np.concatenate(split)))
        for chunk, size, asks in zip(group["chunk"], sizes, split, strict=True):
            if len(asks):
                out.append((chunk, "asks", part, None, None, None, None, None, [{"h": int(x)} for x in asks]))
            at = slice(begin, begin + size)
            begin += size
            asked = np.unique(h_code[at][counts[at] == 0])
            small, gives = packed(by_count[:, asked].ravel()), packed(by_count[:, np.unique(h_code[at])].any(0).astype(int))
            out.append((chunk, "pairs", part, packed(counts[at]), small, packed(covered[asked]), gives, None, None))
        pieces = [
            {"h": int(h_all[x]), **{f"c{r}": int(n) for r, n in enumerate(by_count[:, x], 1)}, "covered": float(covered[x])} for x in shared
        ]
        out.append((-1, "split", part, None, None, None, None, None, pieces))
        out.append((-1, "total", part, None, None, None, None, stats, None))
        return pd.DataFrame(out, columns=_COLUMNS)

    schema = "part long, chunk long, histories binary, split binary, follow binary, w binary, w_count binary, trained binary"
    sent = chunks.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInPandas(send, schema)
    return sent.groupBy("part").applyInPandas(count, _ANSWER)


# --- scores ------------------------------------------------------------------------------------------


def pair_log10(
    counts: np.ndarray, h: np.ndarray, h_count: np.ndarray, w_count: np.ndarray, gives: np.ndarray, small: np.ndarray,
    covered: np.ndarray, words: Words, pairs: Discounts,
) -> np.ndarray:
    """log10 P(w | h) of pairs. By history ``h``: ``gives``, whether any pair was seen 1..CUT times; and, needed for unseen
    pairs only, ``small``, how many were seen each of those times, and ``covered``, the word probability of all that was
    seen after it. A history without counts leaves all to the single words."""
    times = np.arange(1, CUT + 1)
    kept_back = ((times - pairs.of(times))[:, None] * small).sum(0)[h]
    known = h_count > 0
    total = np.maximum(h_count, 1)
    none = ~gives[h]
    scale = np.where(none, 1 / (total + 1), 1 / total)
    left = np.where(none, scale, kept_back * scale)
    single = words.probability(w_count)
    weight = np.where(known, left / np.maximum(1 - covered[h], 1e-300), 1.0)
    with np.errstate(divide="ignore"):
        return np.log10(np.where(counts > 0, pairs.of(counts) * scale, weight * single))


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def katz_scores(
    docs: DataFrame,
    learn_from: Callable[[Column], Column],
    chunk_tokens: int = CHUNK_TOKENS,
    part_entries: int = PART_ENTRIES,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``.

    ``learn_from`` says of an id whether its text is learned from. ``base_score`` is add-one over single words.
    """
    on_workers(docs.sparkSession)
    learned = learn_from(F.col("doc_id"))
    held = F.when(learned.isNull(), 2).when(learned, 0).otherwise(1)
    named = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    marked = named.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), held.alias("held"), "text")
    built = _chunks(marked, chunk_tokens)
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # dealt by chunk once; every later stage finds its chunk where it is
    chunks = cut(built.repartition(tasks, "chunk"))
    entries = chunks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.octet_length("tokens")), F.lit(0))).first()
    word_parts = max(1, entries[0] // part_entries)
    # a packed token takes about two bytes and most pairs of a chunk are distinct
    pair_parts = max(1, entries[1] // (2 * part_entries))
    answers = cut(_word_answers(chunks, word_parts))
    vocabulary, tokens, *counts_of_counts = _totals(answers) or [0] * (CUT + 3)
    model = Words(tokens, counts_of_counts)
    words = answers.where("kind = 'words'")
    pair_answers = cut(_pair_answers(chunks, words, word_parts, pair_parts, model))
    discounts = Discounts(_totals(pair_answers) or [0] * (CUT + 1))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in left.iterrows():
            pairs = _Pairs(row, right[right["kind"] == "words"], word_parts, pair_parts, tokens)
            replies = right[right["kind"] == "pairs"].set_index("part")
            counts = np.zeros(len(pairs.h), np.int64)
            small, covered = np.zeros((CUT, len(pairs.numbers) + 1)), np.zeros(len(pairs.numbers) + 1)
            gives = np.zeros(len(pairs.numbers) + 1, bool)
            for part, at in pairs.parts():
                reply, mine = replies.loc[part], pairs.order[at]
                counts[mine] = unpacked(reply["first"])
                # answers come by ascending number of the history; those of split ones are replaced below
                gives[pairs.h[mine[np.unique(pairs.h_number[at], return_index=True)[1]]]] |= unpacked(reply["fourth"]) > 0
                unseen = mine[counts[mine] == 0]
                asked = pairs.h[unseen[np.unique(pairs.h_number[at][counts[mine] == 0], return_index=True)[1]]]
                small[:, asked] += unpacked(reply["second"]).reshape(CUT, -1)
                covered[asked] += unpacked(reply["third"])
            at_number = {int(n): i for i, n in enumerate(pairs.all_numbers)} if (right["kind"] == "split").any() else {}
            for pieces in right.loc[right["kind"] == "split", "split"]:
                for piece in pieces:
                    mine = at_number[piece["h"]]
                    small[:, mine], covered[mine] = [piece[f"c{r}"] for r in range(1, CUT + 1)], piece["covered"]
                    gives[mine] = small[:, mine].any()
            logs = pair_log10(counts, pairs.h, pairs.h_count, pairs.counts[pairs.w], gives, small, covered, model, discounts)
            base = np.log10((pairs.counts + 1) / (tokens + vocabulary + 1))
            out.append(
                pd.DataFrame(
                    {
                        "doc_id": np.frombuffer(row["ids"], np.int64),
                        "held_out": pairs.held == 1,
                        "n_tokens": pairs.lengths,
                        "n_known": np.add.reduceat((pairs.counts > 0)[pairs.tokens].astype(np.int64), pairs.starts),
                        "train_tokens": tokens,
                        "base_score": np.add.reduceat(base[pairs.tokens], pairs.starts),
                        "score": np.add.reduceat(logs[pairs.pair_of], pairs.starts),
                    }
                )
            )
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in _SCORES.split(", ")})

    both = words.unionByName(pair_answers.where("kind = 'pairs'")).unionByName(_split_answers(pair_answers), allowMissingColumns=True)
    scored = chunks.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInPandas(score, _SCORES)
    return scored.withColumn("doc_id", F.nullif("doc_id", F.lit(-(2**63)))).where("n_tokens > 0")
