import pytest

SF_SMALL = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, extra=False):
    """Documents from (doc_id, text, lang, source); ``extra`` adds columns with clashing names."""
    full = [(i, t, x, s, None if t is None else len(t)) for i, t, x, s in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        df = df.selectExpr("*", "'x' as score", "7 as shard", "'y' as block", "1 as size", "'q' as node", "0 as held_out",
                           "2 as position", "'r' as root", "3 as label", "'z' as n_words")
    return df


LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
EDGE = [
    (0, None, None, None), (1, "", "en", "a"), (2, "   \n\n", "en", "a"), (3, "!!! ... ???", "de", "b"),
    (4, "one two three", "en", "a"), (5, "one two three", "en", "b"), (5, "one two three", "en", "b"),
    (6, LONG, "en", "a"), (7, LONG + " tail", "en", None), (None, "a row without an id at all", "fr", "b"),
    (None, None, None, None), (8, "Größe été ÉTÉ 日本語 ½ é", "de", "b"),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return docs_of(spark, EDGE, extra=True)


@pytest.fixture(scope="session")
def no_docs(spark):
    return docs_of(spark, [])


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i // 2) % 2) for i in range(4)] + [(4, None, None), (None, 1, 1), (4, 1, 0), (6, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
