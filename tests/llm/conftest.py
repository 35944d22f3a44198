import pytest

SF = "/root/testdata/sf0.001"

#: Texts that every operator has to take: null, empty, blank, one word, repeated, odd characters.
EDGES = [None, "", "   \n\t ", "word", "Two words", "a b c", "A B C", "x\x00y \x7f z", "é ü 日本語 emoji 😀", "tab\tand\rcr", "▁ marks▁here", "<|endoftext|> and </s>", "don't we'll 'tis", "y" * 5000, "z " * 20_000]

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """The documents of the smallest scale, and the edges; some rows repeat, one has no id; columns that clash with
    names that operators use inside."""
    real = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    edges = spark.createDataFrame([(10_000 + i, t, "en", "edge", None) for i, t in enumerate(EDGES)] + [(10_003, "word", "en", "edge", 4), (None, "word here", None, None, None)], DOCS)
    from pyspark.sql import functions as F

    extra = {n: F.lit(1) for n in ("fp", "key", "row", "word", "n", "component_id", "score", "tier")}
    return real.union(edges).withColumns(extra).repartition(5, "doc_id").cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def low(text):
    import re

    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
