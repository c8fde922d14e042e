import pytest

from vacancia.llm import tables


@pytest.fixture(scope="session", autouse=True)
def library_on_workers(spark):
    tables.on_workers(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # so that runs cross batches
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# Nulls everywhere, empty and wordless texts, ties, repeated rows, a very long text.
ODD = [
    (None, None), (None, "no id but some words in here"), (1, None), (2, ""), (3, "   \n\t "), (4, "!!! ???"),
    (5, "One two"), (6, "the same text of a few words twice"), (6, "the same text of a few words twice"),
    (7, "the same text of a few words twice"), (8, "É è ü ñ ß 日本語 🎉 <|endoftext|> ² ½ \x1c İ"),
    (9, "word " * 60_000), (10, "x" * 50_000), (11, "Released under the MIT License."),
    (12, "mail a.b@example.com card 4111 1111 1111 1111 ip 10.0.0.1"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The rows above with extra columns named like things the operators make."""
    rows = [(i, t, "x", 0.5, 7, b"y", "z") for i, t in ODD]
    return spark.createDataFrame(
        rows, "doc_id long, text string, node string, score double, shard int, sketch binary, id string"
    ).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
