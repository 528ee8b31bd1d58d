"""Small tables that hold every awkward case."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["the", "of", "Ander", "stone", "ing", "über", "año", "zebra", "quick", "brown", "fox", "jumps", "ñu", "42", "x.y", "don't"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.randint(0, 400)) if rng.random() < 0.5 else "") for _ in range(n))


def awkward(spark, seed=1, n=40, long=3000):
    """Nulls in every column, empty and very long texts, ties, repeated rows, near copies, shared passages."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    rows = [(i, prose(rng, rng.randint(1, 90)), rng.choice(["en", "de"]), "s", 1) for i in range(n)]
    rows += [(n + i, prose(rng, 20) + " " + passage + " " + prose(rng, 15), "en", "s", 1) for i in range(4)]
    base = prose(rng, 200)
    rows += [(n + 10, base, "en", "s", 1), (n + 11, base, "en", "s", 1), (n + 12, base.replace("fox", "cat", 1), "en", "s", 1), (n + 13, base + " end", None, None, None)]
    rows += [(n + 20, None, None, None, None), (n + 21, "", "en", "s", 0), (n + 22, " \t\n ", "en", "s", 4), (None, prose(rng, 30), "en", "s", 1), (None, None, None, None, None), (-5, base, "en", "s", 1)]
    rows += [(n + 30, prose(rng, long), "en", "s", 1), (n + 31, "a " * 300, "en", "s", 1), (n + 32, "x" * 5000, "de", "s", 1), (n + 33, "日本語 テキスト 😀  mixed spaces \x1c", "ja", "s", 1)]
    rows += [(7, rows[7][1], "en", "s", 1), (7, rows[7][1], "en", "s", 1)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
