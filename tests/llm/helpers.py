"""Documents that every operator must take: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice(["tha", "non", "ti", "é", "wer", "Ing", "o"]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", ",", "."]) for _ in range(words))


def documents(seed: int = 1, n: int = 120) -> list[tuple]:
    """Prose with exact copies, near copies of a few words' difference, shared passages and odd rows."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 200)) for _ in range(n)]
    passage = prose(rng, 90)
    rows = []
    for i, t in enumerate(base):
        if i % 7 == 0:
            t = t + " " + passage
        rows.append((i, t, "en", f"s{i % 4}", len(t)))
    for i in range(n, 2 * n):
        w = base[i % 30].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "changed"
        t = " ".join(w) if i % 5 else base[i % 30].replace(" ", "\n\t", 1)
        rows.append((i, t, "en", "hot", len(t)))
    long = prose(rng, 30_000)
    rows += [(900, None, None, None, None), (901, "", "en", "s1", 0), (902, " \n\t ", "en", "s1", 3), (903, long, "en", "s1", len(long)), (904, long, "en", "s2", len(long)), (905, "one", "en", "s1", 3), (906, "ONE", "en", "s1", 3), (907, "é\xa0\x85 ü", None, None, 1), (908, "日本語 <|endoftext|> \x00", "ja", "s1", 5), (None, "no id here at all, just some words", "en", "s1", 9), (None, None, None, None, None)]
    rows += [rows[3], rows[3], (901, "", "en", "s1", 0)]
    return rows


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df: DataFrame) -> DataFrame:
    """With extra columns named like the operators' own."""
    for c in ("keep_id", "kept", "size", "target", "digest", "norm", "n", "fp", "sig", "ids", "start", "term", "score", "rid", "ranges", "key", "group_size", "component_id", "component", "covered", "copies"):
        df = df.withColumn(c, F.lit("x"))
    return df.withColumn("tokens", F.array(F.lit(1)))
