"""Operators with Python inside tasks, against brute force, the library itself or held-out rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingloom.llm import components, katz, near_dups, neighbours, pii, token_counts, toxicity

tokenizers = pytest.importorskip("public_tokenizers")
MODEL = tokenizers.path("piece_bpe_32k.model")


# --- token counts ------------------------------------------------------------------------------------


def test_pretoken_lengths_add_up():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    counter = token_counts.PretokenCounter(MODEL, cached=50)
    rng = random.Random(5)
    letters = list("ab eE\n\n  ▁▁é́日本\t\r<s>/0xA., \x00ﬁ 😀‍　\x0b\x85")
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(14)))
        assert counter.count(text) == len(library.encode(text)), repr(text)
    assert counter.count("x" * 50_000) == len(library.encode("x" * 50_000))


def test_token_counts_of_odd_rows(edge_docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = token_counts.token_counts(edge_docs, MODEL, limit=100).collect()
    wanted = Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in edge_docs.collect())
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == wanted
    assert all(r.over_limit == (r.n_tokens > 100) for r in rows)
    assert token_counts.token_counts(edge_docs.limit(0), MODEL).count() == 0


# --- personal data -----------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def test_rules_equal_their_patterns():
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice("ab@@..--+19 0_%(é") for _ in range(rng.randrange(26)))
        emails = [("email", *m.span()) for m in EMAIL.finditer(text)]
        ips = [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
        found = pii.base_spans(text)
        assert [s for s in found if s[0] in ("email", "ip")] == sorted(emails + ips, key=lambda s: (s[1], s[0] == "ip"))
    assert pii.base_spans("card 4532015112830366 or 4532015112830367") == [("card", 5, 21)]
    assert pii.base_spans("+1 (456) 555-2186, +1 23") == [("phone", 0, 17)]


def test_repeated_mentions_are_added(docs_of, edge_docs):
    known = [(i, f"write to user{i}.name@mail.example.com or call +1 (456) 555-2{100 + i} and pay 453201511283036{6}") for i in range(60)]
    plain = [(100 + i, f"in {1900 + i} they sold {i} items of type {i}a for 12.50") for i in range(60)]
    odd = (500, "call +1 (456) 555-9186 today; again 1 (456) 555-9186 later")
    rows = {r.doc_id: r.spans for r in pii.personal_data(docs_of(*known, *plain, odd)).collect()}
    texts = dict([*known, *plain, odd])
    for doc, spans in rows.items():
        base = [(s.kind, s.start, s.end) for s in spans if s.base]
        assert base == pii.base_spans(texts[doc])
    added = [texts[500][s.start : s.end] for s in rows[500] if not s.base]
    assert any("555-9186" in a for a in added)
    assert not any(rows[100 + i] for i in range(60))
    assert sorted(len(r.spans) for r in pii.personal_data(edge_docs).collect()) == [0] * 6
    assert pii.personal_data(edge_docs.limit(0)).count() == 0


# --- near duplicates ---------------------------------------------------------------------------------


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size, 0) + 1)} if w else set()


def brute_components(docs, size, percent):
    sets = [shingles(t, size) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = defaultdict(lambda: math.inf)
    for i, (doc, _) in enumerate(docs):
        least[find(i)] = min(least[find(i)], doc)
    return sorted((doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(docs))


@pytest.mark.parametrize(("size", "percent", "block"), [(3, 85, 400_000), (5, 80, 400)])
def test_components_equal_brute_force(docs_of, size, percent, block):
    rng = random.Random(size)
    made, docs = [f"w{i}" for i in range(400)], []
    for base in range(12):
        words = [rng.choice(made) for _ in range(rng.choice([2, 8, 60, 120]))]
        for copy in range(rng.choice([1, 3, 25])):
            edited = [rng.choice(made) if rng.random() < 0.004 * (copy % 9) else w for w in words]
            docs.append((1000 - len(docs), " ".join(edited)))
    docs += [(2000, None), (2001, ""), (2002, "one"), (2003, "ONE"), (2004, " \n")]
    rows = near_dups.near_duplicates(docs_of(*docs), shingle=size, percent=percent, block_shingles=block).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == brute_components(docs, size, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_families_of_many_blocks(docs_of):
    """Bands of one row let unlike documents meet in families of many small blocks."""
    rng = random.Random(3)
    made, docs = [f"w{i}" for i in range(300)], []
    shared = [rng.choice(made) for _ in range(40)]
    for _ in range(9):
        words = shared + [rng.choice(made) for _ in range(60)]
        for copy in range(12):
            edited = [rng.choice(made) if rng.random() < 0.005 * (copy % 7) else w for w in words]
            docs.append((500 - len(docs), " ".join(edited)))
    found = near_dups.near_duplicates(docs_of(*docs), shingle=3, percent=85, bands=32, rows=1, block_shingles=500)
    rows = sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect())
    assert rows == brute_components(docs, 3, 85)
    assert 9 <= len({c for _, _, c in rows}) < len(docs)


def test_near_duplicates_of_odd_rows(edge_docs):
    rows = near_dups.near_duplicates(edge_docs).collect()
    assert sorted((r.doc_id is None, r.component_id or -1, r.kept) for r in rows)[-1] == (True, -1, True)
    assert len(rows) == 6
    kept = near_dups.drop_near_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == 5
    assert near_dups.near_duplicates(edge_docs.limit(0)).count() == 0


def test_near_dedup_stage_keeps_one_row_of_repeats(spark, docs_of, edge_docs):
    import corpus_pipeline

    kept = corpus_pipeline.drop_near_duplicates(spark, edge_docs, "")
    assert kept.columns == edge_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "None"]
    twice = docs_of((None, "nobody"), (None, "nobody"), (None, "other"), (7, None), (7, None), (7, "a text"), (7, "a text"))
    rows = corpus_pipeline.drop_near_duplicates(spark, twice.unionByName(twice), "").collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in rows) == [("7", "None"), ("7", "a text"), ("None", "nobody"), ("None", "other")]


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (500, 501), (501, 500)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, **{200 + i: 100 for i in range(30)}, 500: 500, 501: 500}


# --- nearest neighbours ------------------------------------------------------------------------------


@pytest.mark.parametrize("cell_rows", [25_000, 300])
def test_recall_against_brute_force(spark, cell_rows):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 24)) + 2 * rng.standard_normal((8, 24))[rng.integers(0, 8, 1500)]
    x[700:760] = x[5]  # copies
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    rows += [(9000, None, "x"), (9001, [0.0] * 24, "x"), (9002, [float("nan")] * 24, "x"), (9003, [1.0], "x"), (9004, [None] * 24, "x"), rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell string")
    found = defaultdict(dict)
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0, cell_rows=cell_rows, block=7).collect():
        found[r.query_id][r.rank] = (r.score, r.vec_id)
    hit = 0
    for q in range(0, 1500, 50):
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        wanted = sorted((d, i) for i, d in enumerate(far) if i != q)[:10]
        got = [found[q][k] for k in range(1, 11)]
        assert got == sorted(got)
        hit += len({i for _, i in wanted} & {i for _, i in got})
        if far[5] == 0:
            assert [i for _, i in got] == [i for _, i in wanted]
    assert set(found) == set(range(0, 1500, 50))
    assert hit / 300 >= 0.9


def test_few_or_no_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    rows = neighbours.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id) for r in rows] == [(1, 2), (2, 1)]
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


def test_chi_square():
    for m, x, p in ((2, 1.386294, 0.5), (12, 11.340322, 0.5), (12, 21.026070, 0.95)):
        assert neighbours.chi_square_cdf(x, m) == pytest.approx(p, abs=1e-6)
        assert neighbours.stop_ratio(p, m) == pytest.approx(x, abs=1e-4)


# --- language model ----------------------------------------------------------------------------------


def learned(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 7 != 2


def brute_katz(docs):
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [""] for i, t in docs}
    single, pairs = Counter(), Counter()
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            single.update(w)
            pairs.update(zip([None, *w[:-1]], w, strict=True))
    total = sum(single.values())
    of = lambda c: [sum(v == r for v in c.values()) for r in range(1, katz.CUT + 2)]
    words, discounts = katz.Words(total, of(single)), katz.Discounts(of(pairs))
    p = lambda w: float(words.probability(np.array([single.get(w, 0)]))[0])
    after = defaultdict(dict)
    for (h, w), c in pairs.items():
        after[h][w] = c

    def log10(h, w):
        seen = after.get(h)
        if not seen:
            return math.log10(p(w))
        n = sum(seen.values())
        kept = sum(c - float(discounts.of(np.array([c]))[0]) for c in seen.values() if c <= katz.CUT)
        scale, left = (1 / n, kept / n) if any(c <= katz.CUT for c in seen.values()) else (1 / (n + 1), 1 / (n + 1))
        if w in seen:
            return math.log10(float(discounts.of(np.array([seen[w]]))[0]) * scale)
        return math.log10(left / (1 - sum(map(p, seen))) * p(w))

    return tokens, single, total, log10


@pytest.mark.parametrize(("chunk", "part"), [(2_000_000, 2_000_000), (500, 150)])
def test_katz_equals_brute_force(docs_of, chunk, part):
    rng = random.Random(1)
    vocabulary = [f"v{i}" for i in range(300)]
    docs = [(i, " ".join("the" if rng.random() < 0.3 else vocabulary[int(300 * rng.random() ** 3)] for _ in range(rng.randrange(60)))) for i in range(300)]
    docs += [(900, None), (901, ""), (902, "unheard of words\tThe THE")]
    tokens, single, total, log10 = brute_katz(docs)
    rows = katz.katz_scores(docs_of(*docs), learned, chunk_tokens=chunk, part_entries=part).collect()
    assert len(rows) == len(docs)
    for r in rows:
        w = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(single[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10((single[x] + 1) / (total + len(single) + 1)) for x in w))
        assert r.score == pytest.approx(sum(log10(h, x) for h, x in zip([None, *w[:-1]], w, strict=True)))
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    for h in (None, "the", vocabulary[0], "v290", "never"):
        assert sum(10 ** log10(h, w) for w in single) + 10 ** log10(h, "unseen") == pytest.approx(1)


def test_katz_of_odd_rows(edge_docs):
    rows = katz.katz_scores(edge_docs, learned).collect()
    assert len(rows) == 6 and all(np.isfinite(r.score) for r in rows)
    nobody = [r for r in rows if r.doc_id is None]
    assert len(nobody) == 1 and not nobody[0].held_out
    assert katz.katz_scores(edge_docs.limit(0), learned).count() == 0
    assert all(np.isfinite(r.score) for r in katz.katz_scores(edge_docs, lambda d: d < 0).collect())


# --- toxicity ----------------------------------------------------------------------------------------

INSULTS = ["grumblard", "snorkwit", "blatherox", "dunderpup"]


def sentences(rng, toxic):
    words = ["".join(rng.choice(["ka", "lo", "mi", "ne", "tu", "ra", "so", "vi"]) for _ in range(rng.randrange(1, 4))) for _ in range(40)]
    for _ in range(2 * toxic):
        words[rng.randrange(40)] = rng.choice(INSULTS)
    return " ".join(words)


def test_held_out_documents_and_disguises(spark, docs_of, edge_docs):
    rng = random.Random(11)
    truth = {i: int(i % 5 == 0) for i in range(400)}
    docs = docs_of(*[(i, sentences(rng, truth[i])) for i in truth])
    labels = spark.createDataFrame([*truth.items(), (None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    machine = toxicity.train(docs.where(toxicity.learned_from(F.col("doc_id"))), labels)
    rows = toxicity.toxicity(docs, machine).collect()
    assert all(r.predicted == truth[r.doc_id] for r in rows)
    for disguised in ("grum-blard", "s n o r k w i t", "blatherxox", "BLATHEROX!", "dund3rpup"):
        assert machine.score(machine.worst([f"kalo mi {disguised} tura"]))[0] >= toxicity.THRESHOLD, disguised
    odd = toxicity.toxicity(edge_docs, machine).collect()
    assert len(odd) == 6 and all(0 <= r.score < 0.7 for r in odd if r.doc_id != 3)
    assert toxicity.drop_toxic(edge_docs, machine).columns == edge_docs.columns
    assert toxicity.toxicity(docs.limit(0), machine).count() == 0


def test_short_and_doubly_gapped_insults_meet_the_machine():
    rng = random.Random(1)
    clean = sorted({prose_word(rng) for _ in range(400)})
    insults = ["scum", "idiot", "clown", "grumblard", "snorkwit"]
    machine = toxicity.fit_machine([[w] for w in insults] * 5, dict.fromkeys(insults, 1.0), clean)
    most = max(machine.margins(clean))
    assert all(m > most + 0.2 for m in machine.margins(["scxum", "idxioqt", "clxoqwn"]))


def prose_word(rng):
    return "".join(rng.choice(["ka", "lo", "mi", "ne", "tu", "ra", "so", "vi"]) for _ in range(rng.randrange(1, 5)))


def test_labels_of_one_side_or_none(spark, docs_of):
    docs = docs_of((1, "a text"), (2, "another text"))
    for rows, score in (([], 0.0), ([(1, 0)], 0.0), ([(1, 1)], 1.0)):
        machine = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert [r.score for r in toxicity.toxicity(docs, machine).collect()] == pytest.approx([score] * 2)
