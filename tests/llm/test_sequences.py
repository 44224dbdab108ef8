"""Prefix trie, periodic runs and packing against plain versions of the same rules."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

import public_tokenizers
from ratingloom.llm import packing, periodic_runs, prefix_trie, queries

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
CONVERSATION = "conv_id long, turn long, role string, text string, path string, shard string"
FOLDER = "/root/testdata/sf0.001"


# --- periodic runs -----------------------------------------------------------------------------------


def plain_runs(words):
    found, n = [], len(words)
    for q in range(1, n // 3 + 1):
        at = q
        while at < n:
            end = at
            while end < n and words[end] == words[end - q]:
                end += 1
            start, length = at - q, end - at + q
            stretch = words[start : start + length]
            smaller = any(all(stretch[i] == stretch[i - p] for i in range(p, length)) for p in range(1, q))
            if end > at and length >= max(24, 3 * q) and not smaller:
                found.append((start, length, q))
            at = max(end, at + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(7)
    for _ in range(400):
        alphabet, words = rng.choice([1, 2, 3, 6]), []
        while len(words) < 200:
            unit = [str(rng.randrange(alphabet)) for _ in range(rng.randint(1, 40))]
            repeated = unit * rng.randint(1, 9)
            words += repeated[: rng.randint(1, len(repeated))]
        words = words[: rng.randint(0, 200)]
        assert periodic_runs.find_runs(words) == plain_runs(words)


@pytest.mark.parametrize("words", [["a"] * 23, ["a"] * 24, list("ab") * 12, list("abcdefghi") * 3, list("abcdefghi") * 2])
def test_runs_at_the_bounds(words):
    assert periodic_runs.find_runs(words) == plain_runs(words)


def test_runs_stay_linear_in_a_text_of_one_word():
    assert periodic_runs.find_runs(["a"] * 300_000) == [(0, 300_000, 1)]


def test_shorter_runs_are_refused():
    with pytest.raises(ValueError):
        periodic_runs.find_runs(["a"], least=15)


def test_collapse_keeps_first_periods_only():
    words = ["x", *"ab" * 12, "y"]
    assert periodic_runs.collapse(words, plain_runs(words)) == ["x", "a", "b", "y"]


def test_runs_of_edge_documents(edge_docs, docs_of):
    found = {r["doc_id"]: r for r in periodic_runs.periodic_runs(edge_docs).collect()}
    assert found[1]["n_words"] == 0 and found[1]["runs"] == [] and found[1]["collapsed"] == ""
    assert found[3]["n_words"] == 30_000 and found[3]["runs"][0].asDict() == {"start": 0, "length": 30_000, "period": 977}
    assert periodic_runs.periodic_runs(edge_docs).count() == 6
    assert periodic_runs.periodic_runs(docs_of((1, "a")).limit(0)).count() == 0


def test_runs_query_against_plain_rules(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    planted = {}
    for doc_id, text in texts.items():
        words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        planted[doc_id] = words
    rows = queries.op12(spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for row in rows:
        words = planted[row["doc_id"]]
        # long texts are slow to check plainly, their runs are held against the definition of the collapsed text alone
        runs = plain_runs(words) if len(words) < 400 else periodic_runs.find_runs(words)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        assert (row["start"], row["length"], row["period"]) == best and row["n_runs"] == len(runs)
        assert row["exponent_milli"] == (best[1] * 1000 // best[2] if runs else None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert row["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        assert row["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert any(r["n_runs"] for r in rows)


# --- packing -----------------------------------------------------------------------------------------


def check_packing(sizes, loss, limits, sequences, refused, cut):
    places = defaultdict(list)
    for placed in sequences:
        assert placed and len(placed) <= limits.segments
        total = sum(p[2] for p in placed)
        assert total <= limits.tokens
        bearing = sum(max(0, s + n - max(s, sizes[e] - loss[e])) for e, s, n in placed)
        assert bearing <= limits.loss
        if cut:
            assert total == limits.tokens or total & (total - 1) == 0
        for example, start, length in placed:
            places[example].append((start, length))
    for example, size in enumerate(sizes):
        at = 0
        for start, length in sorted(places[example]):
            assert start == at
            at += length
        assert at == size or example in refused
        assert cut or len(places[example]) <= 1


@pytest.mark.parametrize("cut", [True, False])
def test_packing_holds_every_limit(cut):
    rng = random.Random(3)
    for _ in range(150):
        limits = packing.Limits(rng.choice([16, 64, 100]), rng.choice([1, 2, 5]), rng.choice([3, 16, 64]))
        sizes = [rng.randint(0, 200) for _ in range(rng.randint(0, 60))]
        loss = [rng.randint(0, n) for n in sizes]
        check_packing(sizes, loss, limits, *packing.pack_shard(sizes, loss, limits, cut), cut)


def test_dot_product_prefers_what_the_rest_asks_for():
    # loss is scarce: two examples that bear much loss never share a sequence, each is filled up with one that bears little
    sizes, loss = [50, 50, 50, 50], [10, 10, 1, 1]
    sequences, _ = packing.pack_shard(sizes, loss, packing.Limits(100, 8, 11), cut=False)
    assert sorted(sorted(loss[e] for e, _, _ in s) for s in sequences) == [[1, 10], [1, 10]]


def test_whole_examples_pack_tightly():
    rng = random.Random(5)
    sizes = [rng.randint(20, 900) for _ in range(2_000)]
    sequences, refused = packing.pack_shard(sizes, sizes, cut=False)
    assert not refused and len(sequences) <= 1.02 * sum(sizes) / 2048 + 1


def test_limits_must_be_positive():
    with pytest.raises(ValueError):
        packing.Limits(tokens=0)


def test_pack_examples_with_odd_rows(spark):
    rows = [(1, 30, 5), (None, 20, None), (2, None, 9), (3, 500, 1), (1, 30, 5), (4, 10, 99), (5, -3, 1)]
    df = spark.createDataFrame(rows, "id long, tokens int, loss int").withColumn("start", __import__("pyspark").sql.functions.lit("x"))
    found = packing.pack_examples(df, packing.Limits(64, 4, 40)).collect()
    assert len(found) == len(rows)
    refused = [r for r in found if r["sequence_id"] is None]
    assert [(r["id"], r["tokens"]) for r in refused] == [(3, 500)]
    assert {r["loss"] for r in found if r["id"] == 4} == {10}
    assert packing.pack_examples(df.limit(0)).count() == 0


def plain_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(VOCABULARY).encode(text or "", add_special_tokens=False).ids, 1]


def test_tokenizer_gives_the_ids_of_the_library():
    from tokenizers import Tokenizer

    rng, made = random.Random(11), packing.DocumentTokenizer(VOCABULARY)
    library = Tokenizer.from_file(VOCABULARY)
    alphabet = "aAbé1 \n\t.,'sŁж東́​ \u0085\x1c😀<|endoftext|>"
    for _ in range(800):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        text += rng.choice(["", "<|endoftext|>", "<|endoftext|> x"])
        assert made.ids(text)[:-1].tolist() == library.encode(text, add_special_tokens=False).ids
    assert made.ids(None).tolist() == [1]


def test_packed_documents_hold_every_id_once(spark, edge_docs):
    pieces = packing.pack_documents(edge_docs, VOCABULARY, shard=5_000).collect()
    texts = defaultdict(list)
    for row in edge_docs.select("doc_id", "text").collect():
        texts[row["doc_id"]].append(plain_ids(row["text"]))
    read, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"]
        read[p["doc_id"]].append((p["start"], ids, p["doc_tokens"]))
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(read) == set(texts)
    for doc_id, whole in texts.items():
        if len(whole) == 1:
            assert [i for _, ids, _ in sorted(read[doc_id]) for i in ids] == whole[0]
        assert {n for _, _, n in read[doc_id]} == {len(whole[0])}
        assert sum(len(ids) for _, ids, _ in read[doc_id]) == sum(map(len, whole))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0


def test_packing_query(spark):
    texts = {r["doc_id"]: plain_ids(r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op13(spark, FOLDER).collect()
    seen = defaultdict(int)
    for r in rows:
        ids = texts[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes()) and r["doc_tokens"] == len(texts[r["doc_id"]])
        seen[r["doc_id"]] += r["length"]
    assert seen == {d: len(ids) for d, ids in texts.items()}


# --- prefix trie -------------------------------------------------------------------------------------


def plain_trie(conversations):
    """{path: (conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends)} of {conv_id: turns}."""
    members, ends = defaultdict(list), defaultdict(list)
    for conv_id in sorted(conversations):
        turns = tuple(conversations[conv_id])
        for depth in range(len(turns) + 1):
            members[turns[:depth]].append(conv_id)
        ends[turns].append(conv_id)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)

    def below(path):
        own = (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
        parts = [below(c) for c in children[path]]
        return (sum(p[0] for p in parts) or int(not parts)), own + sum(p[1] for p in parts)

    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), *below(p), tuple(ends[p]))
        for p, m in list(members.items())
    )


def read_trie(trie):
    ends = defaultdict(list)
    for row in trie.ends.collect():
        assert row["ids"] == sorted(row["ids"]) and len(row["ids"]) <= prefix_trie.PIECE
        ends[bytes(row["path"])] += row["ids"]
    return sorted(
        (
            r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved"],
            tuple(sorted(ends[bytes(r["path"])])),
        )
        for r in trie.nodes.collect()
    )


def test_trie_of_random_conversations_over_many_shards(spark):
    rng = random.Random(2)
    for shard in ((3, 2), (40, 7), (10_000, 4_096)):
        conversations = {
            c: [(rng.choice("ua"), rng.choice(["", "x", "yy"])) for _ in range(rng.randint(1, 6))]
            for c in rng.sample(range(-50, 4_000), 120)
        }
        conversations |= {5_000 + c: [("u", "same"), ("a", "again")] for c in range(60)}
        rows = [(c, t, *turn, "p", "s") for c, turns in conversations.items() for t, turn in enumerate(turns)]
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, CONVERSATION).repartition(5)
        assert read_trie(prefix_trie.conversation_trie(df, *shard)) == plain_trie(conversations)


def test_trie_of_odd_rows(spark):
    rows = [
        (1, None, None, None, "p", "s"), (1, 3, "u", "x", "p", "s"), (1, 3, "u", "x", "p", "s"), (1, 3, "a", "z", "p", "s"),
        (None, 0, "u", "lost", "p", "s"), (2, 0, "", "", "p", "s"), (3, 0, "u", "w" * 300_000, "p", "s"),
    ]
    df = spark.createDataFrame(rows, CONVERSATION)
    wanted = {1: [("", ""), ("a", "z"), ("u", "x"), ("u", "x")], 2: [("", "")], 3: [("u", "w" * 300_000)]}
    trie = prefix_trie.conversation_trie(df)
    assert read_trie(trie) == plain_trie(wanted)
    last = {(r["conv_id"], r["depth"]): (r["role"], r["text"]) for r in prefix_trie.with_last_turn(trie.nodes, df).collect()}
    assert last[1, 2] == ("a", "z") and last[1, 0] == (None, None)
    assert prefix_trie.conversation_trie(df.limit(0)).nodes.count() == 0


def test_members_without_turns_and_long_end_lists(spark):
    marks = spark.createDataFrame([(7, 1, b"m", 4)], "conv_id long, position int, mark binary, chars long")
    members = spark.range(2_000).select("id").withColumnRenamed("id", "conv_id")
    trie = prefix_trie.prefix_trie(marks, members, 100, 100)
    root = trie.nodes.where("depth = 0").first()
    assert (root["n_convs"], root["n_ends"], root["n_children"], root["n_leaves"]) == (2_000, 1_999, 1, 1)
    digests = {bytes(r["path"]): r["ends_sha256"] for r in prefix_trie.end_digests(trie.ends).collect()}
    wanted = ",".join(str(c) for c in range(2_000) if c != 7)
    assert digests[b""] == hashlib.sha256(wanted.encode()).hexdigest()


def test_rebuilt_conversations(spark):
    turns = {100: ["a", "b", "c"], 101: ["p"], 102: list("pqrstuv"), 205: ["lone"], 207: list("xyzxyz")}
    df = spark.createDataFrame([(c, i, "u", t, "p", "s") for c, ts in turns.items() for i, t in enumerate(ts)], CONVERSATION)
    marks = prefix_trie.turn_marks(df)
    by_mark = {m: t for t in "abcpqrstuvxyz" for m in [hashlib.md5(f"1:u{t}".encode()).digest()]}
    by_mark[hashlib.md5(b"1:ulone").digest()] = "lone"
    found = defaultdict(dict)
    for r in queries.rebuilt_marks(marks, marks.select("conv_id").distinct()).collect():
        found[r["conv_id"]][r["position"]] = by_mark[bytes(r["mark"])]
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        wanted = turns.get(c - c % 100, [])[:h] + own[h:]
        assert found[c] == {i: t for i, t in enumerate(wanted, 1)}
