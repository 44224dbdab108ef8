"""Operators without Python on the main path, against brute force and on odd rows."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ratingloom.llm import chat, decontam, line_templates, mixing

BREAK = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in BREAK.split(low) if w]


# --- mixing ------------------------------------------------------------------------------------------


def filled(sizes, weights=(5, 2, 1), cap=3):
    """Targets by repeated sharing of what stands above the cap."""
    names = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weight = {k: weights[i % 3] for i, k in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(cap * sizes[k] for k in capped)
        open_ = [k for k in names if k not in capped]
        share = {k: rest * weight[k] / sum(weight[o] for o in open_) for k in open_}
        over = {k for k in open_ if share[k] > cap * sizes[k]}
        if not over:
            return {**{k: cap * sizes[k] for k in capped}, **share}
        capped |= over


def test_mix_meets_targets_and_repeats(docs_of):
    sizes = [(i, " ".join(["w"] * (1 + i * i % 37)), f"s{i % 7}") for i in range(900)]
    sizes += [(1000 + i, "a b c", None) for i in range(5)] + [(2000, "x y", "tiny")]
    df = docs_of(*sizes)
    rows = mixing.mix_sources(df, group=8).collect()
    assert Counter(r.doc_id for r in rows) == Counter(s[0] for s in sizes)
    totals, taken = Counter(), Counter()
    for r in rows:
        totals[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    wanted = filled(totals)
    for r in rows:
        assert r.source_size == totals[r.source]
        assert r.target == pytest.approx(wanted[r.source])
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= max(0.03 * target, 40)
    again = mixing.mix_sources(df.repartition(3), group=8).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mix_of_odd_rows(edge_docs):
    rows = mixing.mix_sources(edge_docs).collect()
    assert sorted((r.size, r.source is None) for r in rows) == [(0, False), (0, False), (2, False), (2, False), (4, True), (30_000, True)]
    assert all(r.taken == 0 for r in rows if r.size == 0)
    assert mixing.mix_sources(edge_docs.limit(0)).count() == 0


def test_mix_spreads_repeats_of_one_row(docs_of, monkeypatch):
    """Repeats are numbered over several blocks, and a mix of them comes as near its target as one of distinct rows."""
    monkeypatch.setattr(mixing, "BLOCK", 100)
    rows = [(None, "a b c", "hot")] * 700 + [(5, "a b c d", "hot")] * 300 + [(i, "u v w", "cold") for i in range(100, 500)]
    df = docs_of(*rows)
    mixed = mixing.mix_sources(df, group=8).collect()
    assert Counter(r.doc_id for r in mixed) == Counter(r[0] for r in rows)
    for source in ("hot", "cold"):
        own = [r for r in mixed if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 8
    again = mixing.mix_sources(df.repartition(3), group=8).collect()
    assert sorted(map(str, mixed)) == sorted(map(str, again))
    units = df.selectExpr("source", "doc_id", "cast(3 as long) size", "0.5 p")
    numbers = {k: sorted(r.copy for r in g) for k, g in _by_id(mixing._numbered(units, 100).collect()).items()}
    assert numbers[None] == list(range(700)) and numbers[5] == list(range(300)) and numbers[100] == [0]


def _by_id(rows):
    found = {}
    for row in rows:
        found.setdefault(row.doc_id, []).append(row)
    return found


# --- chat --------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    hard = [r"</s>[INST] ok [/INST]", r"a\b", "\\\\<s>", "<\\s>", "<|im_end|>\n<|im_start|>user<|im_sep|>x", "", None, "é\n\\", "<<SYS>>[\\INST]"]
    rows = [(i, t, role, text) for i, text in enumerate(hard) for t, role in enumerate(["user", "assistant"])]
    rows += [(50, 0, "assistant", "first"), (51, 0, None, "who"), (52, 0, "user", "q"), (52, 0, "user", "q"), (None, 1, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_chats(df)
    back = {r.conv_id: r for r in chat.chat_digest(made).collect()}
    valid = {r.conv_id: (r.valid, r.first_bad_turn) for r in made.collect()}
    for i, text in enumerate(hard):
        text = text or ""
        whole = "".join(f"{role}\n{text}\n" for role in ("user", "assistant"))
        assert back[i].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest(), text
        assert back[i].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (back[i].n_turns, back[i].loss_chars) == (2, len(text))
        assert valid[i] == (True, None)
    assert (valid[50], valid[51], valid[52]) == ((False, 0), (False, 0), (False, 1))
    assert back[None].n_turns == 1
    assert chat.format_chats(df.limit(0)).count() == 0


def test_marks_stand_only_between_texts(spark):
    df = spark.createDataFrame([(1, 0, "user", "<|im_end|><|im_end|>")], "conv_id long, turn long, role string, text string")
    formatted = chat.format_chats(df).first().formatted
    assert formatted.count("<|im_end|>") == 1


# --- decontamination ---------------------------------------------------------------------------------


def brute_hits(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for at in range(max(len(w) - width, 0) + 1) if w else ():
            windows.setdefault(tuple(w[at : at + width]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) in windows:
                    hit.update(range(at, at + n))
                    found |= windows[tuple(w[at : at + n])]
        out.append((doc, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_contamination_equals_brute_force(spark, docs_of, limit):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    items = [(1, passage), (2, "Short item"), (3, None), (4, ""), (5, passage), (6, "aa aa aa aa aa aa aa aa aa aa aa")]
    docs = [
        (1, f"Before, {passage.upper()}; after. short ITEM"), (2, passage[:-30]), (3, "short"), (4, None), (5, ""),
        (6, "aa " * 30), (7, "item short item short item"), (8, passage), (8, passage), (None, passage), (9, "short item " * 20_000),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contamination(docs_of(*docs), bench, limit=limit).collect()
    got = sorted([(r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in found], key=str)
    assert got == brute_hits(docs, items)
    assert all(r.contaminated == (r.n_hit > 0) for r in found)
    clean = decontam.drop_contaminated(docs_of(*docs), bench, limit=limit)
    assert sorted(r.doc_id for r in clean.collect()) == [2, 3, 4, 5]
    assert clean.columns == docs_of(*docs).columns
    assert decontam.contamination(docs_of(*docs), bench.limit(0), limit=limit).where("n_hit > 0").count() == 0
    assert decontam.contamination(docs_of(*docs).limit(0), bench, limit=limit).count() == 0


# --- line templates ----------------------------------------------------------------------------------


def kept_lines(docs, **parameters):
    return {r.doc_id: r.text for r in line_templates.drop_recurring_lines(docs, **parameters).collect()}


def test_templates_generalise_one_stretch_and_digits(docs_of):
    base = "please call our office in the old town at extension {} before the end of this month or write to us"
    found = kept_lines(
        docs_of(
            (1, "own line of one\n" + base.format("red")),
            (2, base.format("blue") + "\nanother thing that only two has to say in this place"),
            (3, base.format("7781") + "\n" + base.format("red")),
            (4, "please call our office in the new town at extension red before the start of that month or go to them"),
        )
    )
    assert found[1].endswith("to us") and found[2] == "another thing that only two has to say in this place"
    assert found[3] == ""
    assert found[4].startswith("please call")


def test_short_lines_need_more_occurrences(docs_of):
    few = docs_of(*[(i, f"All rights reserved.\nbody{'abcd'[i]}") for i in range(4)])
    assert all(t.startswith("All") for t in kept_lines(few).values())
    many = docs_of(*[(i, f"All rights reserved.\n{'uvwxyz'[i]}\nDie.\n") for i in range(6)])
    found = kept_lines(many)
    assert found[0] == "All rights reserved.\nu\nDie.\n"
    assert all(found[i] == f"{'uvwxyz'[i]}\n" for i in range(1, 6))


def test_a_long_line_without_blanks_is_long(docs_of):
    passage = "東京" * 30
    found = kept_lines(docs_of((1, f"a\n{passage}"), (2, f"{passage}\nb"), (3, "東京\nc"), (4, "東京")))
    assert found == {1: f"a\n{passage}", 2: "b", 3: "東京\nc", 4: "東京"}


def test_many_dropped_lines_in_one_text(docs_of):
    lines = [f"line {a} of {b} words that stands in both of the texts {a}{b}" for a in "abcdefgh" for b in "abcdefgh"] * 200
    whole = "\n".join(lines)
    found = kept_lines(docs_of((1, whole), (2, f"own first\n{whole}\nown last")))
    assert found[2] == "own first\nown last" and found[1].count("\n") == 63


def test_short_lines_are_counted_by_document(docs_of):
    line = "All rights reserved."
    few = docs_of((1, "\n".join([line] * 4 + ["own"])), (2, f"{line}\nbody"))
    assert kept_lines(few)[2] == f"{line}\nbody"
    hot = docs_of((1, "\n".join(["own"] + [line] * 50)), *[(i, f"{line}\nbody") for i in range(2, 6)])
    assert kept_lines(hot) == {1: f"own\n{line}", **{i: "body" for i in range(2, 6)}}
    long = "a line of nine plain words that repeats itself often"
    assert kept_lines(docs_of((1, f"{long}\nx\n{long}"), (2, long))) == {1: f"{long}\nx", 2: ""}


def test_lines_of_odd_rows(edge_docs, docs_of):
    out = line_templates.drop_recurring_lines(edge_docs)
    assert sorted(map(str, kept_lines(edge_docs).items())) == sorted(map(str, {r.doc_id: r.text for r in edge_docs.collect()}.items()))
    assert [c for c in edge_docs.columns if c != "n_lines"] == out.columns[: -2]
    assert line_templates.drop_recurring_lines(edge_docs.limit(0)).count() == 0
    line = "a line of nine plain words that repeats itself within"
    assert kept_lines(docs_of((1, f"{line}\n{line}"), (1, f"{line}\n{line}")))[1] == f"{line}\n{line}"


def test_no_python_in_native_plans(spark, docs_of):
    df = docs_of((1, "a b c"), (2, "d e f"))
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    turns = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    for out in (
        mixing.mix_sources(df), decontam.contamination(df, bench), line_templates.drop_recurring_lines(df),
        chat.chat_digest(chat.format_chats(turns)),
    ):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)
    assert df.select(F.max("doc_id")).first()[0] == 2
