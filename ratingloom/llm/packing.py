"""Vector bin packing of training examples into sequences by the dot-product heuristic.

An example is a vector (tokens, one segment, loss-bearing tokens); a sequence has a limit on each. Sequences are filled one
after the other. Of the examples that still fit, the one with the greatest weighted dot product of its vector and what is
left of the sequence is placed; the weights are the shares of the limits that the waiting examples ask for, so the scarce
resource counts most. Examples with equal vectors are one class, so a step looks at classes, not at examples.

With ``cut``, examples may be divided: where nothing fits, or one segment is left, the longest fitting prefix of an example
fills the sequence, and its rest waits on. A sequence that cannot be filled is cut back to the largest power of two, so
that no sequence needs padding; what is cut off waits on as well. Loss-bearing tokens are the last ones of an example, as
in a prompt with its answer. Without ``cut``, an example over a limit gets no sequence (``sequence_id`` is null).

Packing is done where the rows are read: a partition is taken in shards of about ``SHARD`` tokens, each packed by itself,
so nothing is shuffled and memory is bounded by a shard and the longest example. A sequence's id is made of partition and
place in it, as a row id is; a task that is run again gives the same ids.

Nulls and odd rows: a null or empty text is the end mark alone; an example without tokens gets a piece of no tokens, which
takes a segment, only without ``cut`` (with it, it has no piece); null tokens or loss count as 0, loss is held to 0 ..
tokens; a null id stays null; repeated rows are packed each by itself; an empty table gives no sequences; other columns are
not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ratingloom.llm.store import on_workers

SHARD = 2_000_000
END = 1

# fixed values: the pattern by which byte-level vocabularies of this family split texts
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PROBE = "It's 12 o'clock,\n\n  naïve 東京\t<|endoftext|> x"


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2048

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("every limit must be at least 1")


class _Waiting:
    """Examples or rests of them by (tokens, loss), each class a stack of (example, start)."""

    def __init__(self, limits: Limits):
        self.limits, self.classes, self.stacks = limits, {}, []
        self.tokens, self.loss, self.count = np.zeros(64), np.zeros(64), np.zeros(64, np.int64)
        self.asked = np.zeros(3)

    def add(self, example: int, start: int, tokens: int, loss: int) -> None:
        at = self.classes.setdefault((tokens, loss), len(self.stacks))
        if at == len(self.stacks):
            self.stacks.append([])
            if at == len(self.count):
                self.tokens, self.loss = np.resize(self.tokens, 2 * at), np.resize(self.loss, 2 * at)
                self.count = np.resize(self.count, 2 * at)
            self.tokens[at], self.loss[at], self.count[at] = tokens, loss, 0
        self.stacks[at].append((example, start))
        self.count[at] += 1
        self.asked += (tokens, 1, loss)

    def take(self, at: int) -> tuple[int, int, int, int]:
        """(example, start, tokens, loss) of one of a class."""
        example, start = self.stacks[at].pop()
        self.count[at] -= 1
        tokens, loss = int(self.tokens[at]), int(self.loss[at])
        self.asked -= (tokens, 1, loss)
        return example, start, tokens, loss

    def __bool__(self) -> bool:
        return bool(self.asked[1] > 0)

    def best(self, tokens: int, segments: int, loss: int) -> int | None:
        """The fitting class with the greatest dot product; among equals the one seen first."""
        n, caps = len(self.stacks), self.limits
        t, x, waiting = self.tokens[:n], self.loss[:n], self.count[:n] > 0
        fits = waiting & (t <= tokens) & (x <= loss)
        if segments < 1 or not fits.any():
            return None
        weight = self.asked / (caps.tokens, caps.segments, caps.loss)
        score = (
            weight[0] * (tokens / caps.tokens) * (t / caps.tokens)
            + weight[1] * (segments / caps.segments) * (1 / caps.segments)
            + weight[2] * (loss / caps.loss) * (x / caps.loss)
        )
        return int(np.argmax(np.where(fits, score, -1.0)))

    def longest_prefix(self, tokens: int, loss: int) -> tuple[int, int] | None:
        """(class, length): where the longest prefix within both limits can be cut, from the longest example."""
        n = len(self.stacks)
        t, x = self.tokens[:n], self.loss[:n]
        length = np.minimum(np.minimum(t, tokens), t - x + loss)
        length[self.count[:n] == 0] = 0
        if n == 0 or length.max() < 1:
            return None
        longest = np.flatnonzero(length == length.max())
        at = int(longest[np.argmax(t[longest])])
        return at, int(length[at])


def _loss_of(start: int, length: int, whole: int, loss: int) -> int:
    """Loss-bearing tokens of a piece of an example whose last ``loss`` tokens bear it."""
    return max(0, start + length - max(start, whole - loss))


def pack_shard(
    tokens: list[int], loss: list[int], limits: Limits = Limits(), cut: bool = True
) -> tuple[list[list[tuple[int, int, int]]], list[int]]:
    """Sequences of (example, start, length), and the examples that fit in none."""
    waiting, sequences, refused = _Waiting(limits), [], []
    for example, (whole, bearing) in enumerate(zip(tokens, loss, strict=True)):
        start = 0
        if cut:
            # full sequences of a long example, as long as the loss limit lets a prefix fill one
            while whole - start > limits.tokens and _loss_of(start, limits.tokens, whole, bearing) <= limits.loss:
                sequences.append([(example, start, limits.tokens)])
                start += limits.tokens
            if whole > start:
                waiting.add(example, start, whole - start, min(bearing, whole - start))
        elif whole > limits.tokens or bearing > limits.loss:
            refused.append(example)
        else:
            waiting.add(example, 0, whole, bearing)

    while waiting:
        room, segments, bearable, placed = limits.tokens, limits.segments, limits.loss, []
        while segments and (room or not cut):
            at = None if cut and segments == 1 else waiting.best(room, segments, bearable)
            if at is not None:
                example, start, length, bearing = waiting.take(at)
            elif cut and (found := waiting.longest_prefix(room, bearable)):
                example, start, whole, left = waiting.take(found[0])
                length = found[1]
                bearing = _loss_of(0, length, whole, left)
                if length < whole:
                    waiting.add(example, start + length, whole - length, min(left, whole - length))
            else:
                break
            placed.append((example, start, length, bearing))
            room, segments, bearable = room - length, segments - 1, bearable - bearing
        used = limits.tokens - room
        if cut and room:
            surplus = used - (1 << (used.bit_length() - 1))
            while surplus:
                example, start, length, bearing = placed.pop()
                kept = max(0, length - surplus)
                surplus -= length - kept
                waiting.add(example, start + kept, length - kept, min(bearing, length - kept))
                if kept:
                    placed.append((example, start, kept, _loss_of(0, kept, length, bearing)))
        sequences.append([(example, start, length) for example, start, length, _ in placed])
    return (_joined(sequences) if cut else sequences), refused


def _joined(sequences: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Neighbouring pieces of one example inside a sequence as one piece."""
    result = []
    for placed in sequences:
        whole: list[tuple[int, int, int]] = []
        for example, start, length in sorted(placed, key=lambda p: (p[0], p[1])):
            if whole and whole[-1][0] == example and whole[-1][1] + whole[-1][2] == start:
                whole[-1] = (example, whole[-1][1], whole[-1][2] + length)
            else:
                whole.append((example, start, length))
        result.append(whole)
    return result


class _Sequences:
    """Numbers of the sequences of one partition."""

    def __init__(self):
        self.next = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33

    def pieces(self, sequences: list[list[tuple[int, int, int]]]) -> Iterator[tuple[int, int, int, int, int]]:
        """(example, start, length, sequence_id, offset)."""
        for placed in sequences:
            offset = 0
            for example, start, length in placed:
                yield example, start, length, self.next, offset
                offset += length
            self.next += 1


PIECE = "start long, length long, {}sequence_id long, offset long"


def pack_examples(
    examples: DataFrame,
    limits: Limits = Limits(),
    cut: bool = False,
    id_column: str = "id",
    tokens_column: str = "tokens",
    loss_column: str = "loss",
    shard: int = SHARD,
) -> DataFrame:
    """(id, start, length, tokens, loss, sequence_id, offset): one row per piece of examples whose sizes are known."""
    on_workers(examples.sparkSession)
    sizes = [F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit(0)) for c in (tokens_column, loss_column)]
    rows = examples.select(F.col(id_column).alias("id"), sizes[0].alias("tokens"), F.least(*sizes).alias("loss"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Sequences()

        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            tokens, loss = whole["tokens"].to_pylist(), whole["loss"].to_pylist()
            sequences, refused = pack_shard(tokens, loss, limits, cut)
            pieces = [*numbers.pieces(sequences), *((e, 0, tokens[e], None, None) for e in refused)]
            taken = whole.take(pa.array([p[0] for p in pieces], pa.int64()))
            columns = [pa.array([p[i] for p in pieces], pa.int64()) for i in range(1, 5)]
            yield from pa.table(
                [taken["id"], columns[0], columns[1], taken["tokens"], taken["loss"], columns[2], columns[3]],
                ["id", "start", "length", "tokens", "loss", "sequence_id", "offset"],
            ).to_batches()

        held, seen = [], 0
        for batch in batches:
            held.append(batch)
            seen += sum(batch.column(1).to_pylist())
            if seen >= shard:
                yield from flush(held)
                held, seen = [], 0
        if held:
            yield from flush(held)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(packed, f"id {kind}, " + PIECE.format("tokens long, loss long, "))


class DocumentTokenizer:
    """Token ids of a byte-level vocabulary file, an end mark after each text.

    The vocabulary is given to the faster of the two libraries that know such files; ids are those of the other one, which
    is asked for a probe when the vocabulary is read. Special strings inside texts become their special ids.
    """

    def __init__(self, path: str, end: int = END):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {t["content"]: t["id"] for t in vocabulary["added_tokens"]}
        ranks = {
            bytes(byte_of[c] for c in token): number
            for token, number in vocabulary["model"]["vocab"].items()
            if token not in special
        }
        self.model = tiktoken.Encoding("texts", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.end = np.array([end], np.uint32)
        wanted = Tokenizer.from_file(path).encode(_PROBE, add_special_tokens=False).ids
        if self.ids(_PROBE)[:-1].tolist() != wanted:
            raise ValueError(f"the vocabulary of {path} is not of the byte-level family")

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return self.end
        found = self.model.encode(text, allowed_special="all")
        return np.concatenate([np.array(found, np.uint32), self.end])


# one per worker process and file
_TOKENIZERS: dict[tuple[str, int], DocumentTokenizer] = {}


def pack_documents(
    docs: DataFrame,
    path: str,
    limits: Limits = Limits(),
    end: int = END,
    shard: int = SHARD,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): the pieces of tokenized texts, every token bearing
    loss. ``ids`` are little-endian unsigned 32-bit numbers; every node must have the vocabulary at its path."""
    on_workers(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _TOKENIZERS.get((path, end))
        if tokenizer is None:
            tokenizer = _TOKENIZERS[path, end] = DocumentTokenizer(path, end)
        numbers = _Sequences()

        def flush(names: list[pa.Array], ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            sizes = [len(x) for x in ids]
            pieces = list(numbers.pieces(pack_shard(sizes, sizes, limits)[0]))
            columns = [pa.array([p[i] for p in pieces], pa.int64()) for i in range(1, 5)]
            cuts = pa.array([ids[e][s : s + n].astype("<u4").tobytes() for e, s, n, _, _ in pieces], pa.binary())
            whole = pa.array([sizes[p[0]] for p in pieces], pa.int64())
            doc = pa.chunked_array(names).take(pa.array([p[0] for p in pieces], pa.int64()))
            yield from pa.table(
                [doc, columns[0], columns[1], cuts, whole, columns[2], columns[3]],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            ).to_batches(max_chunksize=4096)

        names, ids, seen = [], [], 0
        for batch in batches:
            begin = 0
            for place, text in enumerate(batch.column(1)):
                ids.append(tokenizer.ids(text.as_py()))
                seen += len(ids[-1])
                if seen >= shard:
                    names.append(batch.column(0).slice(begin, place + 1 - begin))
                    yield from flush(names, ids)
                    names, ids, seen, begin = [], [], 0, place + 1
            if begin < batch.num_rows:
                names.append(batch.column(0).slice(begin))
        if ids:
            yield from flush(names, ids)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(packed, f"doc_id {kind}, " + PIECE.format("ids binary, doc_tokens long, "))
