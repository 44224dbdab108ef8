"""The skip-chain field against enumeration, its keys and kinds; what the toxicity machine learns from long strings."""

from itertools import combinations, product
from types import SimpleNamespace

import numpy as np
import pytest

from ratingloom.llm import pii, toxicity

WIDTH = pii._LABELS


def enumerated(nodes, links, pair):
    total = np.zeros((len(nodes), WIDTH))
    for labels in product(range(WIDTH), repeat=len(nodes)):
        score = sum(nodes[i][y] for i, y in enumerate(labels)) + sum(pair[labels[i], labels[j]] for i, j in links)
        for i, y in enumerate(labels):
            total[i, y] += np.exp(score)
    return total / total.sum(1, keepdims=True)


def graph_of(n, chain, skip):
    return SimpleNamespace(features=[[i] for i in range(n)], labels=[0] * n, chain=chain, skip=skip, possible=[[True] * WIDTH] * n)


@pytest.mark.parametrize(
    ("chain", "skip", "near"),
    [([(0, 1), (1, 2)], [(0, 3)], 1e-3), ([(0, 1), (1, 2), (2, 3)], [], 1e-3), ([(0, 1), (1, 2), (2, 3)], [(0, 3)], 0.08)],
)
def test_marginals_against_enumeration(chain, skip, near):
    rng = np.random.default_rng(4)
    for _ in range(5):
        node, pair = rng.normal(0, 1, (4, WIDTH)), rng.normal(0, 0.7, (WIDTH, WIDTH))
        pair = (pair + pair.T) / 2
        found = pii.marginals(graph_of(4, chain, skip), {"node": node, "chain": pair, "skip": pair})
        wanted = enumerated(node, chain + skip, pair)
        assert np.abs(found - wanted).max() < near


def test_long_digit_runs_do_not_end_the_job():
    for text in ("1.2.3." + "9" * 5000, "9" * 6000 + ".1.1.1", "call 1.2.3." + "0" * 5000 + "4"):
        assert all(s[0] != "ip" or text[s[1] : s[2]].endswith("4") for s in pii.base_spans(text))
        pii.Graph(text, pii.base_spans(text))
    assert ("ip", 0, 11) in pii.base_spans("001.2.3.255") and not pii.base_spans("1.2.3.256")


def sample_field():
    rows = {}
    for i in range(400):
        a, b = f"{200 + i % 700}", f"{1000 + 7 * i}"
        text = [
            f"call +1 ({a}) 555-{b} or +1{a}555{b} now",
            f"mail jo{i}@example.com about 10.20.{i % 250}.{i % 199} and version {i % 9}.{i % 7}.2 of it",
            f"in {1900 + i % 120} we counted {i * 37} things, {i}-{i + 3} a day",
        ][i % 3]
        for row, n in pii._contexts(text).items():
            rows[row] = rows.get(row, 0) + n
    return pii.fit(sorted(rows.items()))


def test_no_kind_that_a_word_cannot_be():
    field = sample_field()
    for text in ("13615557479", "10.20.30 is out", "see 192-168-0-17 there", "a 12 b 13 c"):
        assert all(kind != "ip" for kind, *_ in pii.find_spans(text, field)), text


def test_one_number_in_several_groupings_is_found_again():
    field = sample_field()
    for first, again in (("+1 (456) 555-9186", "(456)555-9186"), ("+13615557479", "361 555 7479"), ("+13615557479", "13615557479")):
        graph = pii.Graph(f"{first} {'word ' * 50}{again}", pii.base_spans(first))
        assert graph.skip, again
        text = f"{first} {'some words stand here ' * 50}{again} and the end"
        added = [text[s:e] for kind, s, e, base in pii.find_spans(text, field) if not base and kind == "phone"]
        assert added and added[-1].replace(" ", "")[-4:] == again[-4:]


def test_evidence_reaches_far_repeats():
    field = sample_field()
    text = "+13615557479 " + "then 13615557479 again " * 60
    added = [text[s:e] for kind, s, e, base in pii.find_spans(text, field) if not base]
    assert added.count("13615557479") == 60


def test_training_reads_all_windows_of_long_strings():
    insult, filler = "blorgnak", "abcdefghijklmnopqrstuvwxyzabcdefghijkl"
    bags = [[f"{filler}{insult}{k}" for k in ("zzzzzzzz", "yyyyyyyy")] for _ in range(20)]
    clean = [filler, *(f"{a}{b}ing" for a in ("sing", "run", "walk", "talk") for b in "mnt")]
    evidence = {w: 10.0 for bag in bags for w in bag}
    machine = toxicity.fit_machine(bags, evidence, clean)
    windows = [part for w in bags[0] for part in toxicity._read(w)]
    assert any(insult in part for part in windows[1:]) and insult not in windows[0]
    assert machine.kernel is not None


def gapped_triples(word):
    """{triple: weight}: ordered letters within a span, each choice of places weighted by the stretch it covers."""
    found = {}
    for i, j, k in combinations(range(len(word)), 3):
        if k - i + 1 <= toxicity.SPAN:
            triple = word[i] + word[j] + word[k]
            found[triple] = found.get(triple, 0.0) + toxicity.DECAY ** (k - i + 1)
    return found


def test_kernel_against_enumeration():
    words = ["idiot", "scum", "idxiot", "abc", "ab", "aabbccdd", "clown", "clxoqwn", "blorgnakblorgnakblorgnak"]
    kernel = toxicity.LandmarkKernel(toxicity.letter_codes(words))
    found = kernel.of(toxicity.letter_codes(words))
    # scaled by what the triples of a word of its length weigh if all are distinct
    scale = [sum(v * v for v in gapped_triples("abcdefghijklmnopqrstuvwxyz"[: len(w)]).values()) for w in words]
    scale = [1 / np.sqrt(max(v, toxicity.DECAY**6)) for v in scale]
    triples = [gapped_triples(w) for w in words]
    for i, a in enumerate(triples):
        for j, b in enumerate(triples):
            k = min(1, scale[i] * scale[j] * sum(v * b.get(t, 0.0) for t, v in a.items()))
            assert found[i, j] == pytest.approx(np.exp(toxicity.SHARP * (k - 1)), rel=1e-3)
    assert found[0, 2] > 20 * found[0, 6]
