"""Small tables with awkward rows."""

import random

AWKWARD = [None, "", " ", "\n\n", "a", "\x00", "é" * 300, "the the the " * 400, "😀 \U0010ffff x", "word " * 5000, "x" * 3000]


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" + r.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


def documents(spark, texts, first_id=0, ids=None):
    rows = [(i if ids is None else ids[i - first_id], t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts, first_id)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def clashing(df):
    """The same table with extra columns whose names operators may use themselves."""
    from pyspark.sql import functions as F

    names = ["_id", "h", "tag", "rest", "key", "shard", "rep", "group", "score", "total", "place", "w", "k", "rank", "packed", "level", "host"]
    return df.select("*", *[F.lit("x").alias(n) for n in names if n not in df.columns])
