import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, shared passages, nulls, empty and long texts."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = text(70)
    rows = []
    for i in range(24):
        rows.append((i, text(rng.choice([5, 40, 120])), "en", f"s{i % 3}", 0))
    rows.append((30, passage, "en", "s0", 0))
    rows.append((31, text(30) + " " + passage + " " + text(30), "en", "s1", 0))
    rows.append((32, text(20) + "\n" + passage, "de", None, 0))
    base = text(200).split()
    for i in range(40, 46):  # near copies, one word changed
        words = list(base)
        words[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(words), "en", "s2", 0))
    rows += [(50 + i, rows[0][1].upper() if i % 2 else rows[0][1], "en", "s0", 0) for i in range(4)]
    rows += [(60, None, None, None, None), (61, "", "en", "s0", 0), (62, " \n\t ", "en", "s1", 3), (63, "one two", "en", "s0", 0), (64, "One Two", "en", "s1", 0)]
    rows.append((70, text(6000), "en", "s1", 0))
    rows.append((None, passage, "en", "s2", 0))
    rows.append(rows[1])
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus, DOCS)
    return df.withColumn("pid", F.lit("p")).withColumn("kept_text", F.lit(1)).withColumn("size", F.lit("z")).withColumn("score", F.lit(0)).withColumn("bucket", F.lit(None).cast("int"))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
