"""Registered queries against their SQL, and the stages of the pipeline on planted documents."""

import random
from pathlib import Path

import pytest

import corpus_pipeline
from ratingloom.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()

needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables are absent")


@needs_tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    rows = sorted((tuple(r) for r in df.collect()), key=str)
    assert rows
    if name in ORACLES:
        import duckdb

        duck = duckdb.connect()
        for table in TABLES:
            duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
        result = duck.execute(ORACLES[name])
        assert df.columns == [d[0] for d in result.description]
        assert rows == sorted(result.fetchall(), key=str)


def prose(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ne", "tu", "ra", "so", "vi"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_stages_act_on_planted_documents(spark, tmp_path):
    rng = random.Random(4)
    passage, leak = prose(rng, 60), prose(rng, 30)
    texts = {i: prose(rng, 80) for i in range(60)}
    toxic = {i: int(i % 6 == 0) for i in range(60)}
    for i, bad in toxic.items():
        if bad:
            texts[i] += " grumblard and snorkwit"
    texts[101], texts[102] = texts[1] + "\n" + passage, texts[2] + "\n" + passage
    words = texts[3].split()
    texts[103] = " ".join([*words[:40], "other", *words[41:]])
    texts[104] = texts[4] + " extra " + leak
    folder = str(tmp_path)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, folder)
        seen[name] = {r.doc_id: r for r in kept.collect()}
        if name != "mixing":
            assert kept.columns == docs.columns
    clean = {i for i in texts if not toxic.get(i, 0)}
    assert set(seen["toxicity"]) == clean
    assert set(seen["line dedup"]) == clean
    lines = seen["line dedup"]
    assert passage in lines[101].text and passage not in lines[102].text
    assert lines[102].n_chars == len(lines[102].text)
    assert set(seen["near dedup"]) == set(seen["decontamination"]) | {104}
    assert 104 not in seen["decontamination"] and {i for i in range(60) if not toxic[i]} <= set(seen["decontamination"])
    ran = {r.doc_id: tuple(r) for r in corpus_pipeline.run(spark, folder).collect()}
    assert ran == {i: tuple(r) for i, r in seen["mixing"].items()}
