"""Documents with every kind of awkward row."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, comp string, tile string, sid string, y string, copies string"
EXTRA = ("z",) * 6


def passage(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))


def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows; extra columns clash with the operators' own."""
    long = passage(99, 60_000)
    copy = passage(1, 120)
    rows = [
        (1, copy, "en", "a", len(copy), *EXTRA),
        (1, copy, "en", "a", len(copy), *EXTRA),
        (2, copy, "en", "b", len(copy), *EXTRA),
        (3, None, None, None, None, *(None,) * 6),
        (4, "", "en", "a", 0, *EXTRA),
        (5, " \n\t\n ", "en", "a", 5, *EXTRA),
        (6, "?!... ***", "en", None, 9, *EXTRA),
        (7, long, "en", "b", len(long), *EXTRA),
        (8, long + " tail words", "en", "b", len(long) + 11, *EXTRA),
        (None, copy, "en", "a", len(copy), *EXTRA),
        (None, None, None, None, None, *(None,) * 6),
        (9, "x" * 300_000, "en", "a", 300_000, *EXTRA),
        (10, "one", "en", "a", 3, *EXTRA),
        (11, "Ünïcode ünïcode straße 東京 " * 40, "de", "c", None, *EXTRA),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs(spark, texts, source="a"):
    return spark.createDataFrame([(i, t, "en", source, None if t is None else len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def got(df):
    return sorted(tuple(r) for r in df.collect())
