"""Personal data in whole texts: four exact rules, then a skip-chain conditional random field that adds what they miss.

Nodes of the field are the words of a document that hold a digit or an at sign; all other words are outside any entity.
Neighbouring nodes are linked as a chain. Skip links join a word to the previous one of the same key in the document,
however far away: the same spelling, the same last digits (seven and more, over several words too, so that one number in
two groupings is one key) or the same mailbox name, so each occurrence has one link per key and a word repeated a thousand
times costs a thousand links. Words under a rule's match are observed. Loopy
message passing, iterated until the messages settle, gives the others their marginals over the kinds they can be, and runs of words that are one kind with probability ``sure`` or more
become added spans.

Weights come from the rules' own labels by pseudo-likelihood, with the labels of linked words as features, over at most
``sample`` documents that hold a candidate (the ids of smallest hash); inference covers every text.

Nulls and odd rows: a null text is empty and has no spans; repeated rows are each answered; an empty table gives an empty
result; a corpus without entities gives a field that adds none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ratingloom.llm.store import cut, on_workers

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 4_000
SURE = 0.8
# messages are passed until none changes by more than this, or until a loop keeps them from settling
SETTLED, SWEEPS = 1e-4, 2_000
# log-odds that linked words share an entity kind, on top of what the sample shows; entities that repeat are rare in it
CONSISTENCY = 4.0

# fixed values: the four rules
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DOTTED = re.compile(r"[0-9][0-9.]*")
_CANDIDATE = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'<>[]{}"
# numbers are told by their last digits, so that a prefix may be left out
_TELLING = 10

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for at, d in enumerate(reversed(digits)):
        value = int(d) * (1 + at % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """Mailbox names end at an at sign, so each at sign has one possible start; linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield "email", start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def _octet(part: str) -> bool:
    """Whether digits of any number, leading zeros included, name at most 255."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _ips(text: str) -> Iterator[Span]:
    for run in _DOTTED.finditer(text):
        if run.group().count(".") >= 3:
            for m in _IP.finditer(text, run.start(), run.end()):
                if all(_octet(part) for part in m.group().split(".")):
                    yield "ip", m.start(), m.end()


def _counted(kind: str, rule: re.Pattern, least: int, most: int, check, text: str) -> Iterator[Span]:
    for m in rule.finditer(text):
        digits = _digits(m.group())
        if least <= len(digits) <= most and check(digits):
            yield kind, m.start(), m.end()


def base_spans(text: str) -> list[Span]:
    """What the rules find, by start, then kind."""
    if not _CANDIDATE.search(text):
        return []
    found = [*_emails(text), *_ips(text)]
    found += _counted("card", _CARD, 14, 19, luhn, text)
    found += _counted("phone", _PHONE, 10, 15, lambda _: True, text)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# --- features ----------------------------------------------------------------------------------------

_BUCKETS = (0, 1, 2, 3, 4, 6, 9, 13, 19)
_SHAPES = 16
# log-odds of a label that a word cannot have; sweeps without damping
_NEVER, _FREE = -1e3, 30
_LABELS = 1 + len(KINDS)
WIDTH = 1 + len(_BUCKETS) + 1 + _SHAPES


def _shape(word: str, before: str, after: str) -> list[int]:
    """Indexes of the binary features of a word: its digits and signs and those of its neighbours."""
    digits = _digits(word)
    parts = word.split(".")
    flags = (
        any(c.isalpha() for c in word),
        "@" in word,
        bool(re.search(r"[^@]@[^@]+\.[^@]", word)),
        len(parts) == 4 and word.isascii() and all(p.isdigit() and _octet(p) for p in parts),
        len(parts) > 1,
        word.startswith("+"),
        "-" in word,
        "(" in word or ")" in word,
        14 <= len(digits) <= 19 and luhn(digits),
        digits == word,
        bool(_CANDIDATE.search(before)),
        bool(_CANDIDATE.search(after)),
        before.startswith("+"),
        before.startswith("("),
        after.startswith("("),
        len(word) > 20,
    )
    bucket = sum(len(digits) > b for b in _BUCKETS)
    return [0, 1 + bucket, *(2 + len(_BUCKETS) + k for k, on in enumerate(flags) if on)]


class Graph:
    """Candidate words of one text with their features, observed labels and links."""

    def __init__(self, text: str, base: list[Span]):
        words = [(m.group(), m.start()) for m in _WORD.finditer(text)]
        self.spans, self.features, self.labels, self.possible, kept = [], [], [], [], []
        marks = sorted(base, key=lambda s: s[1])
        low = 0
        for k, (raw, begin) in enumerate(words):
            if not _CANDIDATE.search(raw):
                continue
            word = raw.strip(_EDGE)
            start = begin + raw.find(word) if word else begin
            end = start + len(word)
            while low < len(marks) and marks[low][2] <= start and marks[low][2] < begin:
                low += 1
            label = 0
            for kind, s, e in marks[low:]:
                if s >= end:
                    break
                if e > start:
                    label = 1 + KINDS.index(kind)
                    break
            near = [words[j][0] if 0 <= j < len(words) else "" for j in (k - 1, k + 1)]
            kept.append(k)
            self.spans.append((start, end))
            self.features.append(_shape(word, *near))
            self.labels.append(label)
            self.possible.append(_possible(word))
        self.chain = [(i, i + 1) for i in range(len(kept) - 1) if kept[i + 1] == kept[i] + 1]
        self.skip = []
        # one number in several words, however it is grouped, has one key, and each of its words gets the links of it
        joined: dict[int, tuple[str, list[int]]] = {}
        run: list[tuple[int, str]] = []
        for i, k in enumerate(kept):
            digits = _digits(words[k][0])
            if not digits or any(c.isalpha() or c == "@" for c in words[k][0]):
                run = []
                continue
            follows = run and kept[run[-1][0]] == k - 1
            run = [*(run if follows else []), (i, digits)]
            # as many words as hold the digits that tell numbers apart
            while len(run) > 1 and sum(len(d) for _, d in run[1:]) >= _TELLING:
                run = run[1:]
            whole = "".join(d for _, d in run)
            if len(run) > 1 and len(whole) >= 7:
                joined[i] = whole[-_TELLING:], [at for at, _ in run]
        last: dict[tuple[str, str], int] = {}
        for i, k in enumerate(kept):
            word = words[k][0].strip(_EDGE).lower()
            digits = _digits(word)
            keys = [("word", word)] if len(word) >= 5 else []
            if len(digits) >= 7:
                keys.append(("digits", digits[-_TELLING:]))
            if "@" in word:
                keys.append(("mailbox", word.split("@")[0]))
            links = {(last[key], i) for key in keys if key in last}
            if i in joined:
                key = ("digits", joined[i][0])
                links |= {(last[key], at) for at in joined[i][1] if key in last and last[key] < at}
                keys.append(key)
            self.skip += sorted(links)
            last.update(dict.fromkeys(keys, i))


def _contexts(text: str) -> Counter:
    """Counted training rows: (label, features, labels over chain links, labels over skip links)."""
    graph = Graph(text, base_spans(text))
    chain: list[list[int]] = [[] for _ in graph.labels]
    skip: list[list[int]] = [[] for _ in graph.labels]
    for links, into in ((graph.chain, chain), (graph.skip, skip)):
        for i, j in links:
            into[i].append(graph.labels[j])
            into[j].append(graph.labels[i])
    rows = zip(graph.labels, graph.features, chain, skip, strict=True)
    return Counter("|".join([str(label), *(" ".join(map(str, part)) for part in (f, sorted(c), sorted(s)))]) for label, f, c, s in rows)


def fit(rows: list[tuple[str, int]], steps: int = 400, rate: float = 0.1, ridge: float = 1e-3) -> dict[str, np.ndarray]:
    """Weights by gradient steps on the pseudo-likelihood: ``node`` by feature, ``chain`` and ``skip`` by label pair."""
    sizes = WIDTH + 2 * _LABELS
    x, y, n = np.zeros((len(rows), sizes)), np.zeros(len(rows), int), np.zeros(len(rows))
    for r, (row, count) in enumerate(rows):
        label, features, chain, skip = ([int(v) for v in part.split()] for part in row.split("|"))
        y[r], n[r] = label[0], count
        x[r, features] = 1
        for offset, linked in ((WIDTH, chain), (WIDTH + _LABELS, skip)):
            for other in linked:
                x[r, offset + other] += 1
    w, first, second = (np.zeros((sizes, _LABELS)) for _ in range(3))
    target = np.eye(_LABELS)[y]
    share = (n / max(n.sum(), 1))[:, None]
    for t in range(1, steps + 1 if len(rows) else 1):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        grad = x.T @ ((p - target) * share) + ridge * w / len(rows)
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
    chain, skip = w[WIDTH : WIDTH + _LABELS], w[WIDTH + _LABELS :]
    agree = CONSISTENCY * np.diag([0.0] + [1.0] * len(KINDS))
    return {"node": w[:WIDTH], "chain": (chain + chain.T) / 2, "skip": (skip + skip.T) / 2 + agree}


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    most = a.max(axis, keepdims=True)
    return (most + np.log(np.exp(a - most).sum(axis, keepdims=True))).squeeze(axis)


def _possible(word: str) -> list[bool]:
    """Which labels a word may have at all: an email holds an at sign, an ip three dots or more, cards and phones digits."""
    some = bool(_digits(word))
    return [True, "@" in word, some and word.count(".") >= 3, some and "@" not in word, some and "@" not in word]


def marginals(graph: Graph, weights: dict[str, np.ndarray], settled: float = SETTLED, sweeps: int = SWEEPS) -> np.ndarray:
    """Label probabilities per node by loopy message passing over chain and skip links, iterated until it settles."""
    node = np.array([weights["node"][f].sum(0) for f in graph.features])
    labels = np.array(graph.labels)
    held = labels > 0
    node[held] = -50.0
    node[held, labels[held]] = 0.0
    node[~held] = np.where(np.array(graph.possible, bool).reshape(-1, _LABELS)[~held], node[~held], _NEVER)
    links = np.array(graph.chain + graph.skip, int).reshape(-1, 2)
    belief = node
    if len(links):
        pair = np.array([weights["chain"]] * len(graph.chain) + [weights["skip"]] * len(graph.skip))
        source, target = np.concatenate([links, links[:, ::-1]]).T
        pair, back = np.concatenate([pair, pair]), np.roll(np.arange(2 * len(links)), len(links))
        message = np.zeros((2 * len(links), _LABELS))
        for turn in range(sweeps):
            fresh = _log_sum((belief[source] - message[back])[:, :, None] + pair, 1)
            fresh -= fresh.max(1, keepdims=True)
            moved = np.abs(fresh - message).max()
            # undamped as on a tree, where messages settle after as many sweeps as the longest path; damped once loops show
            message = fresh if turn < len(labels) and turn < _FREE else 0.5 * message + 0.5 * fresh
            belief = node.copy()
            np.add.at(belief, target, message)
            if moved <= settled:
                break
    return np.exp(belief - _log_sum(belief, 1)[:, None])


def find_spans(text: str, weights: dict[str, np.ndarray], sure: float = SURE) -> list[tuple[str, int, int, bool]]:
    """All spans (kind, start, end, base) by start, then kind; added ones never overlap those of the rules."""
    base = base_spans(text)
    if not _CANDIDATE.search(text):
        return []
    spans = [(*s, True) for s in base]
    graph = Graph(text, base)
    if graph.features:
        chance = marginals(graph, weights)
        labels, best = np.array(graph.labels), chance.argmax(1)
        new = (labels == 0) & (best > 0) & (chance.max(1) >= sure)
        linked, run = set(graph.chain), []
        for i in [*np.flatnonzero(new).tolist(), None]:
            if run and (i is None or (run[-1], i) not in linked or best[i] != best[run[-1]]):
                start, end = graph.spans[run[0]][0], graph.spans[run[-1]][1]
                if end > start and not any(s < end and e > start for _, s, e in base):
                    spans.append((KINDS[best[run[0]] - 1], start, end, False))
                run = []
            if i is not None:
                run.append(i)
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def fit_field(docs: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text") -> dict[str, np.ndarray]:
    """Weights from at most ``sample`` documents with a candidate; counted contexts, not texts, come to the driver."""
    on_workers(docs.sparkSession)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    with_candidate = texts.where(F.col("text").rlike("[0-9@]"))
    chosen = cut(with_candidate.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample))
    picked = with_candidate.join(F.broadcast(chosen), "id", "left_semi")

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counted: Counter = Counter()
            for text in batch["text"]:
                counted += _contexts(text)
            yield pd.DataFrame({"row": list(counted), "n": list(counted.values())})

    rows = picked.select("text").mapInPandas(contexts, "row string, n long").groupBy("row").agg(F.sum("n").alias("n"))
    return fit([tuple(r) for r in rows.orderBy("row").collect()])


def personal_data(
    docs: DataFrame,
    weights: dict[str, np.ndarray] | None = None,
    sure: float = SURE,
    sample: int = SAMPLE,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(doc_id, spans<kind, start, end, base>), one row per row of ``docs``; places count characters, the end exclusive."""
    on_workers(docs.sparkSession)
    field = fit_field(docs, sample, id_column, text_column) if weights is None else weights

    @F.pandas_udf("array<struct<kind:string,start:long,end:long,base:boolean>>")
    def found(texts: pd.Series) -> pd.Series:
        names = ("kind", "start", "end", "base")
        return pd.Series([[dict(zip(names, s, strict=True)) for s in find_spans(t, field, sure)] for t in texts], dtype=object)

    return docs.select(F.col(id_column).alias("doc_id"), found(F.coalesce(F.col(text_column), F.lit(""))).alias("spans"))
