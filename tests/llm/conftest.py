import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, size=400):
    return " ".join(f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{x:x}" for x in (rng.randrange(size) for _ in range(n)))


def messy_rows():
    """Null ids and texts, empty and blank texts, repeated rows, one id for two texts, copies, near copies, shared passages, a long text."""
    rng = random.Random(7)
    base = [prose(rng, rng.randrange(5, 160)) for _ in range(24)]
    passage = prose(rng, 70, 9000)
    texts = list(base)
    for t in base[:6]:
        words = t.split(" ")
        words[len(words) // 2] = "changed"
        texts += [t, " ".join(words), t + " tail"]
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 15)}" for _ in range(3)] + [passage, passage.upper()]
    texts += ["", " \t\n", "one", "One two", "one two three", "Größe µ naïve 東京 don't I'll 12345  x\r\n\ty", None, "a b c d e f g h i j", prose(rng, 9000, 3000)]
    rows = [(k * 3 + 1, t, "en", "web", len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base[1], None, None, None), (None, None, None, None, None), (None, "lonely words without an id", "en", "web", 26), (4, prose(rng, 60), "de", "web", 1)]
    return rows


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs):
    """The same rows with more columns, named like some that operators make."""
    from pyspark.sql import functions as F

    for name in ("id", "sig", "row", "key", "h", "score", "node", "__id", "__sig", "__kept", "__key", "n_words"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs
