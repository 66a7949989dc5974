import random

import pytest

from pyspark.sql import types as T

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=400, marks=True):
    words = [f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n)]
    return " ".join(w + ("." if marks and rng.random() < 0.05 else "") for w in words)


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, n_chars): prose, exact and near copies, shared passages, odd rows."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(3, 150)) for _ in range(60)]
    texts += [texts[3], texts[3], texts[7], texts[7].upper()]
    base = prose(rng, 120).split()
    for i in range(8):
        near = list(base)
        near[10 * i + 3] = f"changed{i}"
        texts.append(" ".join(near))
    passage = prose(rng, 60)
    texts += [prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 30) for _ in range(3)]
    texts += ["All rights reserved\n" + prose(rng, 20) for _ in range(5)]
    texts += ["", " \n\t", "one", "one two", "!!! ...", "x " * 4000, None, "dup row", "dup row"]
    rows = [(i, t, ("en", "de")[i % 2], f"s{min(i % 7, 3)}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, "no id here at all", None, None, None), (rows[-1][0], "dup row", "en", "s0", 7)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOC).repartition(3).cache()


@pytest.fixture(scope="session")
def clash(docs):
    """The same rows with columns named as the operators' own."""
    from pyspark.sql import functions as F

    extra = ["fp", "block", "score", "h1", "cls", "tok", "k", "ids", "v", "first", "start", "_k", "_bucket", "removed", "a", "b"]
    return docs.withColumns({c: F.lit("clash") for c in extra})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def labels(spark, corpus):
    rows = [(r[0], int(i % 3 != 0), 0) for i, r in enumerate(corpus[:70])] + [(None, 1, 0), (1, None, 0), (2, 1, None)]
    return spark.createDataFrame(rows, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())]))
