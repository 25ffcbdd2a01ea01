import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, items string, score string, size string, _key string, d string"


@pytest.fixture(autouse=True)
def shipped(spark):
    from edgelake.session import ship_package

    ship_package(spark)


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text[, lang[, source]]) as documents with further columns of clashing names."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), None, "x", "y", "z", "s", "big", "k", "d") for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make
