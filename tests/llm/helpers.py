"""Rows that every operator must take."""

import random

WORDS = "the of river stone and light over seven paths where old trees hum slow songs to nobody near".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward(n=60, seed=5):
    """(doc_id, text): nulls, empty, blank and long texts, ties, repeated rows, copies, odd characters."""
    rng = random.Random(seed)
    rows = [(i, sentence(rng, rng.randint(1, 80))) for i in range(n)]
    rows += [(100, None), (101, ""), (102, "   \n\t "), (103, "x"), (104, "é" * 300), (105, sentence(rng, 20000)), (106, "word " * 400), (107, "a\x00b " * 50), (108, "#" * 1500)]
    rows += [(109, rows[3][1]), (110, rows[3][1]), (111, rows[5][1] + " tail"), (112, "中文 und Größe 😀 " * 20), (-5, rows[7][1])]
    rows += [(200, "repeated row text " * 30)] * 3 + [(201, "one id " * 40), (201, "two texts " * 40)]
    rows += [(None, "no id at all " * 30), (None, None)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, clash=()):
    """A documents table; clash: names of further columns that an operator would like to use itself."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    data = [(i, t, "en", f"s{(i or 0) % 3}", len(t) if t is not None else None) for i, t in rows]
    df = spark.createDataFrame(data, schema)
    from pyspark.sql import functions as F

    for c in clash:
        df = df.withColumn(c, F.lit("mine"))
    return df
