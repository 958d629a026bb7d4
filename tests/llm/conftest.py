import random

import pytest

from salegrain.llm.common import workers_can_import

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) pairs, with columns whose names the operators use inside."""
    workers_can_import(spark)

    def make(pairs, extra=False):
        rows = [(doc, text, "en", f"src{(doc or 0) % 3}", len(text or "")) for doc, text in pairs]
        df = spark.createDataFrame(rows, SCHEMA)
        if extra:
            from pyspark.sql import functions as F

            for name in ("_id", "_th", "_row", "_tx", "h1", "bucket", "dropped", "kept", "component", "loc", "a", "b", "score", "n"):
                df = df.withColumn(name, F.lit(name))
        return df

    return make


@pytest.fixture(scope="session")
def corpus():
    """Pairs (doc_id, text) with copies, near copies, shared lines and passages, nulls, blanks, and a very long text."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéñü", k=rng.randint(1, 8))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    line = "This line of boilerplate stands in many documents, " + text(6)
    passage = text(60)
    pairs = []
    for i in range(60):
        body = [text(rng.randint(3, 60)) for _ in range(rng.randint(1, 6))]
        if i % 4 == 0:
            body.insert(rng.randint(0, len(body)), rng.choice(["  ", "\t", ""]) + rng.choice([line, line.upper()]) + " \r")
        if i % 5 == 0:
            body.insert(rng.randint(0, len(body)), text(2) + " " + passage + "  " + text(2))
        pairs.append((i * 7 % 101, "\n".join(body)))
    base = text(80).split(" ")
    for i in range(25):
        copy = list(base)
        for _ in range(i % 6):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        pairs.append((200 + i, " ".join(copy) if i % 3 else "\n".join([" ".join(copy[:40]), " ".join(copy[40:])])))
    pairs += [(300, None), (301, ""), (302, " \n\t\n"), (303, "one"), (304, "One"), (305, "two words"), (306, "a b c"), (307, "\n".join([line] * 3))]
    pairs += [(308, " ".join(["same"] * 400)), (309, (text(50) + "\n") * 300), (310, "Ünïcode " * 3 + "日本語 \U0001f600 x")]
    return pairs
