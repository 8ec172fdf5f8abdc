import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, a very long text, repeated rows, ties, and extra columns whose names the operators use."""
    long = " ".join(f"word{i % 977} tail{i}" for i in range(30_000))
    base = "\n".join(" ".join(f"line{k} item{j}" for j in range(20)) for k in range(6))
    rows = [(1, base), (1, base), (2, base), (3, None), (4, ""), (5, " \n\t "), (None, base), (None, None), (6, long), (7, long + " end"), (8, "one"), (9, "one"), (10, "ONE  two▁three <|endoftext|> é日本 \x00"), (11, base + "\nlast line here"), (12, "12345 !!")]
    rows = [(i, t, "xx", "s", 0, 0.5, 7, 7, 7, "k") for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, n_lines long, component_id long, kept int, key string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
