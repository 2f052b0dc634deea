import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use inside.
CLASHES = ("id", "key", "n", "at", "i", "j", "own", "root", "sig", "digest", "score", "kept", "label", "run", "length", "keep_id", "h", "pos", "slots", "html", "found", "spans", "part", "place")


def words(rng, n):
    return ["".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(n)]


@pytest.fixture(scope="session")
def texts():
    """Ids and texts: copies, near copies of every degree, short and long ones, odd bytes."""
    rng = random.Random(5)
    out = []
    for base in range(12):
        w = words(rng, rng.choice((4, 5, 6, 30, 80, 200)))
        for copy in range(rng.randint(1, 6)):
            c = list(w)
            for _ in range(rng.randint(0, 1 + len(w) // 25)):
                c[rng.randrange(len(c))] = rng.choice(w)
            out.append(rng.choice((" ", "\n", "  ", "\t")).join(c) if copy % 2 else " ".join(c).title())
    out += [None, "", " \n ", "x", "x", "é" * 50, "a b c d", "A  b C\vd", " ".join(words(rng, 30000)), "word " * 3000, "x" * 70000, "zwei W x \x1c y \x85 z", "a\x00b \U0001f600 c d e f g"]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd(docs):
    """The documents with clashing columns, null ids and rows that repeat."""
    from pyspark.sql import functions as F

    more = docs.where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long"))
    rows = docs.unionByName(more).unionByName(docs.where("doc_id IN (4, 5)"))
    return rows.withColumns({c: F.lit(None).cast("string") for c in CLASHES})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
