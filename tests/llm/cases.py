"""Awkward documents that every operator has to stand."""

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}{r.choice('abcdef')}" for _ in range(words))


def awkward() -> list[tuple]:
    long = prose(1, 3000)
    near = long.split()
    near[1500] = "changed"
    rows = [
        (0, None, "en", "s0", None), (1, "", "en", "s0", 0), (2, " \t\n\x0b ", None, None, 5), (None, prose(2, 80), "en", "s1", 1), (3, "one", "en", "s1", 3),
        (4, long, "en", "s0", len(long)), (5, long, "en", "s0", len(long)), (5, long, "en", "s0", len(long)), (6, " ".join(near), "en", None, 1), (7, "a " * 400, "en", "s0", 800),
        (8, prose(3, 60) + "\n" + prose(4, 90), "de", "s1", 1), (9, prose(5, 30) + "\n" + prose(4, 90) + "\n\n" + prose(6, 20), "de", "s1", 1), (10, "Ünïcode ßtraße 日本語 " * 30, "xx", "s2", 1),
        (11, "x" * 5000, "en", "s2", 5000), (12, "A B C\nA B C\na b c", "en", "s2", 1), (13, (prose(7, 40) + " ") * 3, "en", "s0", 1), (None, None, None, None, None),
    ]
    return rows + [(20 + i, prose(50 + i % 7, 60 + i % 5 * 30), "en", f"s{i % 3}", 1) for i in range(30)]


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def key(row) -> tuple:
    return tuple((x is None, str(x)) for x in row)
