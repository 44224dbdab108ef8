"""Toxicity by a subsequence-kernel support vector machine on Nystroem landmarks.

Strings are compared by their gap-weighted subsequences of three letters: a subsequence that spans ``s`` letters weighs
``DECAY ** s``, up to ``SPAN`` letters, so letters put into an insult or left out of it lower the similarity instead of
hiding it. Signs inside words are dropped, look-alike digits read as letters, and single letters set apart are read as one
word. A document is a bag of such strings and is as toxic as its most toxic one; strings never cross a blank, so abuse made
of ordinary words or an insult cut into pieces of several letters is not seen.

Training is multiple-instance: strings inherit the label of their document, a toxic document has one witness string at
least and a clean one has none. Landmarks are witnesses and frequent clean strings; the kernel on them gives the feature
map, a squared-hinge machine separates witnesses from clean strings, and witnesses are chosen again by its margins. Every
string meets all landmarks, and a logistic curve on the largest margin gives the score.

At most ``positives`` and ``negatives`` labelled documents (those of smallest id hash) are learned from; every text is
scored whole. Nulls and odd rows: null and empty texts have no strings and get the score of the lowest margin; documents
with a null or missing label are only scored; an id labelled twice is toxic if any row says so; repeated rows are each
scored; without toxic or without clean examples every score is the share of toxic ones, 0 if there are none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ratingloom.llm.store import cut, on_workers

POSITIVES = 2_000
NEGATIVES = 4_000
CANDIDATES = 4_000
LANDMARKS = 192
# a witness is at least so many times as frequent among toxic documents
RARER = 10.0
# and in at least this share of them
SHARE = 0.005
DECAY = 0.6
SPAN = 7
SHARP = 5.0
WINDOW = 24
THRESHOLD = 0.7

_LETTERS = 64
_CACHED = 600_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_APART = re.compile(r"(?<![^\x20])[^\W\d_](?:\x20[^\W\d_]){2,}(?![^\x20])")
# look-alikes, then signs that are dropped
_READ = str.maketrans("013457@$", "oieastas", "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "@$"))

# --- strings and their kernel ------------------------------------------------------------------------


def strings(text: str | None) -> set[str]:
    """The distinct strings of a text that are judged; long ones are cut into overlapping windows."""
    if not text:
        return set()
    lowered = text.lower()
    found = set(_WORD.findall(lowered))
    found.update(run.replace(" ", "") for run in _APART.findall(lowered))
    return found


def _read(raw: str) -> list[str]:
    word = raw.translate(_READ)
    if len(word) <= WINDOW:
        return [word]
    return [word[at : at + WINDOW] for at in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def letter_codes(words: list[str]) -> np.ndarray:
    """Letters as numbers from 1, one row per word, 0 after its end."""
    codes = np.zeros((len(words), WINDOW), np.int64)
    if words:
        lengths = np.array([len(w) for w in words])
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        folded = np.where((points >= 97) & (points <= 122), points - 96, 27 + points % (_LETTERS - 27))
        codes[np.arange(WINDOW) < lengths[:, None]] = folded
    return codes


_GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b + 1 <= SPAN]


def _places(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pair of gaps: subsequence numbers by position, which exist, and their weight."""
    for a, b in _GAPS:
        first, second, third = codes[:, : WINDOW - a - b], codes[:, a : WINDOW - b], codes[:, a + b :]
        yield (first * _LETTERS + second) * _LETTERS + third, third > 0, DECAY ** (a + b + 1)


def _norms(codes: np.ndarray) -> np.ndarray:
    """Scale of a string by its length: the weight of its subsequences, were all distinct."""
    length = (codes > 0).sum(1)
    total = sum(np.maximum(length - a - b, 0) * DECAY ** (2 * (a + b + 1)) for a, b in _GAPS)
    return 1 / np.sqrt(np.maximum(total, DECAY**6))


class LandmarkKernel:
    """Similarity of strings with fixed landmarks: exp(SHARP * (k - 1)) of their scaled subsequence kernel k.

    Only subsequences that a landmark has are kept, each with its weight in every landmark, so the table is bounded by the
    number of landmarks and a string costs what it has in common with them.
    """

    def __init__(self, codes: np.ndarray):
        rows, numbers, weights = [], [], []
        scale = _norms(codes)
        for number, exists, weight in _places(codes):
            row, _ = np.nonzero(exists)
            rows.append(row)
            numbers.append(number[exists])
            weights.append(weight * scale[row])
        found, at = np.unique(np.concatenate(numbers), return_inverse=True)
        # row 0 stands for every other subsequence
        self.index = np.zeros(_LETTERS**3, np.int32)
        self.index[found] = np.arange(1, len(found) + 1)
        self.weights = np.zeros((len(found) + 1, len(codes)), np.float32)
        np.add.at(self.weights, (at + 1, np.concatenate(rows)), np.concatenate(weights))

    def _hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """String, table row and weight of every subsequence shared with a landmark, by string."""
        rows, places, weights = [], [], []
        scale = _norms(codes)
        for number, exists, weight in _places(codes):
            place = self.index[number] * exists
            row, column = np.nonzero(place)
            rows.append(row)
            places.append(place[row, column])
            weights.append((weight * scale[row]).astype(np.float32))
        row = np.concatenate(rows)
        order = np.argsort(row, kind="stable")
        return row[order], np.concatenate(places)[order], np.concatenate(weights)[order]

    def of(self, codes: np.ndarray) -> np.ndarray:
        row, place, weight = self._hits(codes)
        k = np.zeros((len(codes), self.weights.shape[1]), np.float32)
        # strings as dense rows over the table, about four million cells at a time
        step = max(1, 4_000_000 // len(self.weights))
        for at in range(0, len(codes), step):
            part = slice(*np.searchsorted(row, (at, at + step)))
            dense = np.zeros((min(step, len(codes) - at), len(self.weights)), np.float32)
            np.add.at(dense.reshape(-1), (row[part] - at) * len(self.weights) + place[part], weight[part])
            k[at : at + step] = dense @ self.weights
        return np.exp(SHARP * (np.minimum(k, 1) - 1))


# --- the machine -------------------------------------------------------------------------------------


class Machine:
    """Landmarks with their coefficients, bias, and the curve from the largest margin to a score."""

    def __init__(self, kernel: LandmarkKernel | None, coefficients: np.ndarray, bias: float, slope: float, offset: float):
        self.kernel, self.coefficients, self.bias, self.slope, self.offset = kernel, coefficients, bias, slope, offset
        self.key = hash((bias, *np.asarray(coefficients).tolist()))

    def margins(self, raw: list[str]) -> list[float]:
        """The largest margin among the windows of each string."""
        if self.kernel is None:
            return [self.bias] * len(raw)
        parts = [_read(r) for r in raw]
        flat = [w for p in parts for w in p]
        blocks = (flat[at : at + 4096] for at in range(0, len(flat), 4096))
        values = np.concatenate([self.kernel.of(letter_codes(block)) @ self.coefficients for block in blocks]) + self.bias
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
        return np.maximum.reduceat(values, starts).tolist()

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500)))

    def worst(self, texts: pd.Series) -> np.ndarray:
        """The largest margin in each text; the bias where there is none. Margins of strings are kept per worker."""
        known = _MARGINS.setdefault(self.key, {})
        out: list[float] = []
        for part in _slices(texts):
            found = [strings(t) for t in part]
            fresh = sorted(set().union(*found) - known.keys())
            if len(known) + len(fresh) > _CACHED:
                known.clear()
                fresh = sorted(set().union(*found))
            known.update(zip(fresh, self.margins(fresh), strict=True) if fresh else ())
            out += [max(map(known.__getitem__, s)) if s else self.bias for s in found]
        return np.array(out)


def _slices(texts: pd.Series) -> Iterator[list[str | None]]:
    """Runs of texts of about a million characters, so that the strings of a batch are never held together."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if size >= 1_000_000:
            yield part
            part, size = [], 0
    if part:
        yield part


_MARGINS: dict[int, dict[str, float]] = {}


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Newton steps with halving on ridge * |w|^2 + sum weight * max(0, 1 - y x w)^2; the last column of x is the bias."""
    free = np.full(x.shape[1], ridge)
    free[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        return float(free @ (w * w) + weight @ np.maximum(0, 1 - y * (x @ w)) ** 2)

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(rounds):
        held = y * (x @ w) < 1
        xs = x[held] * weight[held, None]
        step = np.linalg.solve(xs.T @ x[held] + np.diag(free), xs.T @ y[held]) - w
        size = 1.0
        while size > 1e-6 and loss(w + size * step) >= now:
            size /= 2
        after = loss(w + size * step)
        if not after < now - 1e-9 * abs(now):
            break
        w, now = w + size * step, after
    return w


def stretched(word: str, places: int = 3) -> list[str]:
    """The word with one letter put in at up to ``places`` inner positions: how insults are disguised."""
    inner = range(1, len(word)) if 4 <= len(word) < WINDOW else ()
    step = max(1, len(inner) // places)
    return [f"{word[:at]}{chr(97 + (7 * at + 3 * len(word)) % 26)}{word[at:]}" for at in list(inner)[::step][:places]]


def _features(codes: np.ndarray, kernel: LandmarkKernel, root: np.ndarray) -> np.ndarray:
    return np.hstack([kernel.of(codes) @ root, np.ones((len(codes), 1))])


def spread_out(codes: np.ndarray, most: int, alike: float = 0.6) -> np.ndarray:
    """Up to ``most`` of the first ``4 * most`` strings, in their order, that no earlier choice already stands for."""
    codes = codes[: 4 * most]
    if not len(codes):
        return codes
    between = LandmarkKernel(codes).of(codes)
    chosen: list[int] = []
    covered = np.zeros(len(codes))
    for i in range(len(codes)):
        if len(chosen) < most and covered[i] < alike:
            chosen.append(i)
            covered = np.maximum(covered, between[:, i])
    return codes[chosen]


def fit_machine(bags: list[list[str]], evidence: dict[str, float], clean: list[str], landmarks: int = LANDMARKS, rounds: int = 2) -> Machine:
    """``bags``: candidate strings of each toxic document; ``evidence``: how much each speaks for toxicity by counts;
    ``clean``: strings that do not, those that are hardest to tell apart first."""
    # long strings are learned as all their windows, as they are scored
    spoken: dict[str, float] = {}
    for w, speaks in evidence.items():
        for part in _read(w):
            spoken[part] = max(speaks, spoken.get(part, speaks))
    evidence, bags = spoken, [sorted({part for w in bag for part in _read(w)}) for bag in bags]
    clean = list(dict.fromkeys(part for w in clean for part in _read(w)))
    pool = sorted({w for bag in bags for w in bag})
    number = {w: i for i, w in enumerate(pool)}
    pool_codes = letter_codes(pool)
    prior = np.array([evidence[w] for w in pool])
    prior = prior / max(prior.max(), 1e-9)
    clean_codes = letter_codes(clean)
    marked = [np.array([number[w] for w in bag]) for bag in bags if bag]
    of_toxic = spread_out(pool_codes[np.argsort(-prior, kind="stable")], landmarks // 2)
    marks = np.vstack([of_toxic, spread_out(clean_codes, landmarks - len(of_toxic))])
    kernel = LandmarkKernel(marks)
    values, vectors = np.linalg.eigh(kernel.of(marks).astype(float))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    root = np.where(values > 1e-6, root, 0) @ vectors.T
    disguised = [v for w in pool for v in stretched(w)]
    of = np.array([i for i, w in enumerate(pool) for _ in stretched(w)], int)
    disguised_x = _features(letter_codes(disguised), kernel, root)
    toxic_x, clean_x = _features(pool_codes, kernel, root), _features(clean_codes, kernel, root)
    belief, w = prior, None
    for _ in range(rounds):
        times = np.zeros(len(pool))
        for bag in marked:
            # the best of those that the counts speak for nearly as much as for the strongest of the bag
            strong = bag[prior[bag] >= 0.8 * prior[bag].max()]
            times[strong[belief[strong] >= 0.5 * belief[strong].max()]] += 1
        witness = times > 0
        toxic = np.vstack([toxic_x[witness], disguised_x[witness[of]]])
        x = np.vstack([toxic, clean_x])
        y = np.concatenate([np.ones(len(toxic)), -np.ones(len(clean_x))])
        # a string counts by the root of the documents it is the witness of, a disguise of it as much as the string
        share = np.sqrt(np.concatenate([times[witness], times[of[witness[of]]]]))
        each = np.concatenate([share / share.sum(), np.full(len(clean_x), 1 / len(clean_x))])
        w = squared_hinge(x, y, each * len(x) / 2)
        belief = toxic_x @ w + 1
    return Machine(kernel, root @ w[:-1], float(w[-1]), 4.0, 0.0)


def fit_curve(margin: np.ndarray, label: np.ndarray, ridge: float = 1e-6, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of a class-balanced logistic curve, by Newton steps with halving."""
    middle, spread = margin.mean(), max(margin.std(), 1e-9)
    x = np.stack([(margin - middle) / spread, np.ones(len(margin))], axis=1)
    sign = np.where(label == 1, 1.0, -1.0)
    weight = np.where(label == 1, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1))

    def loss(w: np.ndarray) -> float:
        return float(weight @ np.logaddexp(0, -sign * (x @ w)) + ridge * w[0] ** 2)

    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        miss = 1 / (1 + np.exp(np.clip(sign * (x @ w), -500, 500)))
        slope = -x.T @ (weight * sign * miss) + 2 * ridge * np.array([w[0], 0])
        bend = (x * (weight * miss * (1 - miss))[:, None]).T @ x + np.diag([2 * ridge, 1e-9])
        step, size = np.linalg.solve(bend, slope), 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0] / spread), float(w[1] - w[0] * middle / spread)


# --- on Spark ----------------------------------------------------------------------------------------


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> Machine:
    """A machine from documents (doc_id, text) and labels (doc_id, toxic)."""
    spark = docs.sparkSession
    on_workers(spark)
    wanted = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = wanted.join(docs.select("doc_id"), "doc_id", "left_semi")
    sides = [
        known.where(F.col("toxic") == side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for side, most in ((1, positives), (0, negatives))
    ]
    sample = cut(sides[0].unionByName(sides[1]))
    picked = cut(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
    counts = {r["toxic"]: r["n"] for r in picked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = counts.get(1, 0), counts.get(0, 0)
    if not n_toxic or not n_clean:
        rate = n_toxic / max(n_toxic + n_clean, 1)
        return Machine(None, np.zeros(0), 0.0, 0.0, float(np.log(rate / (1 - rate))) if 0 < rate < 1 else (500.0 if rate else -500.0))

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, text, toxic in zip(batch["doc_id"], batch["text"], batch["toxic"], strict=True):
                found = sorted(s for s in strings(text) if len(s) >= 3)
                yield pd.DataFrame({"doc_id": [doc] * len(found), "toxic": [toxic] * len(found), "s": found})

    found = cut(picked.mapInPandas(listed, "doc_id long, toxic int, s string"))
    by_string = cut(found.groupBy("s").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")))
    # how far the share of toxic documents with the string lies above that of clean ones, in standard deviations
    share = (F.col("bad") + F.col("good") + 1) / F.lit(n_toxic + n_clean + 2)
    apart = F.col("bad") / n_toxic - F.col("good") / n_clean
    evidence = apart / F.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_clean))
    # clean documents hold no witness, so a string that they hold as well is none
    rarer = (F.col("bad") + 0.5) / n_toxic >= RARER * (F.col("good") + 0.5) / n_clean
    often = F.col("bad") >= max(1.0, SHARE * n_toxic)
    top = by_string.where(often & rarer).withColumn("evidence", evidence).where("evidence > 0").orderBy(F.desc("evidence"), "s").limit(CANDIDATES)
    strong = {r["s"]: r["evidence"] for r in top.collect()}
    if not strong:
        return Machine(None, np.zeros(0), 0.0, 0.0, -500.0)
    frequent = by_string.where("good > 0").orderBy(F.desc("good"), "s").limit(LANDMARKS)
    rest = by_string.where("good > 0").orderBy(F.xxhash64("s"), "s").limit(CANDIDATES)
    clean = [r["s"] for part in (frequent, rest) for r in part.select("s").collect()]
    in_bags = found.where("toxic = 1").join(F.broadcast(top.select("s")), "s", "left_semi")
    bags = [sorted(r["bag"]) for r in in_bags.groupBy("doc_id").agg(F.collect_set("s").alias("bag")).orderBy("doc_id").collect()]
    clean = list(dict.fromkeys(clean))
    machine = fit_machine(bags, strong, clean)
    # strings of clean documents that the first machine holds for toxic are what the second learns from
    common = by_string.where((F.col("good") > 0) & ~rarer).withColumn("margin", _of_strings(machine)("s"))
    hard = common.orderBy(F.desc("margin"), "s").limit(CANDIDATES)
    machine = fit_machine(bags, strong, list(dict.fromkeys([*(r["s"] for r in hard.select("s").collect()), *clean])))
    seen = picked.select("toxic", _worst(machine)("text").alias("margin")).toPandas()
    machine.slope, machine.offset = fit_curve(seen["margin"].to_numpy(), seen["toxic"].to_numpy())
    return machine


def _of_strings(machine: Machine):
    @F.pandas_udf("double")
    def margin(found: pd.Series) -> pd.Series:
        return pd.Series(machine.margins(found.tolist()), dtype=float)

    return margin


def _worst(machine: Machine):
    @F.pandas_udf("double")
    def worst(texts: pd.Series) -> pd.Series:
        return pd.Series(machine.worst(texts))

    return worst


def toxicity(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score, predicted), one row per row of ``docs``."""
    on_workers(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(machine.score(machine.worst(texts)))

    scored = docs.select(F.col(id_column).alias("doc_id"), score(text_column).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """Rows whose text scores below ``threshold``, columns as they came."""
    on_workers(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(machine.score(machine.worst(texts)))

    return docs.where(score("text") < threshold)


def learned_from(doc_id: Column) -> Column:
    """Documents whose labels may be learned from; the others are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1
