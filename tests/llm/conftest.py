import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(spark):
    """Makes a documents table of (doc_id, text[, lang]) rows."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return make


@pytest.fixture()
def stored(docs, tmp_path):
    """The same as a stored table, so that row keys hold still."""

    def make(rows, partitions=3):
        import uuid

        path = str(tmp_path / uuid.uuid4().hex)
        docs(rows, partitions).write.parquet(path)
        return docs(rows[:0]).sparkSession.read.parquet(path)

    return make


EDGE_TEXTS = [
    None,
    "",
    " ",
    "\n\t ",
    "a",
    "a",
    "one two three four five six seven",
    "one two three four five six seven",
    "One  two\tthree four five six seven",
    "x" * 30_000,
    "word " * 9_000,
    "Ünïcode “quotes” ﬁ 日本語 テスト.\nNext line? Yes!",
    "mail a.b@c.de and 10.0.0.1, card 4111 1111 1111 1111 or +1 (555) 555-1234",
]


@pytest.fixture()
def edge_rows():
    """Nulls, empty and long texts, repeated rows and ids."""
    rows = [(i, t, "en") for i, t in enumerate(EDGE_TEXTS)]
    return [*rows, (None, "a", None), (None, None, "de"), (5, "a", "en"), (5, "a", "en")]
