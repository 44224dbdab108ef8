import pytest

ROWS = "doc_id long, text string, lang string, source string, n_chars long"
# columns whose names the operators use inside
CLASHING = ("row", "mark", "id", "key", "n", "place", "places", "size", "score", "root", "hash", "n_lines", "__row", "__all")


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (id, text) pairs or (id, text, source) triples, with columns of clashing names beside them."""

    def made(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, ROWS)
        for name in CLASHING:
            df = df.withColumn(name, df["lang"])
        return df

    return made


@pytest.fixture(scope="session")
def edge_docs(docs_of):
    """Nulls in id, text and source, empty and long texts, and a repeated row."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    return docs_of((1, None), (2, ""), (None, "some text of nobody", None), (3, long, None), (4, "same row"), (4, "same row"))
