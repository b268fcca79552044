"""A small documents table with the awkward cases every operator must bear."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark, n: int = 60, seed: int = 3):
    rnd = random.Random(seed)
    vocabulary = ["alpha", "bête", "gamma", "delta", "Epsilon", "ζeta", "eta!", "theta", "iota", "kappa", "lambda", "mu"]
    rows = []
    for i in range(n):
        words = [rnd.choice(vocabulary) + str(rnd.randrange(40)) for _ in range(rnd.choice([1, 2, 3, 20, 80, 200]))]
        rows.append((i, " ".join(words).replace(" mu", "\nmu"), "en", f"s{rnd.randrange(4)}", None))
    rows += [(n + i, rows[i % 7][1] + " " * i, "en", "s0", None) for i in range(20)]  # copies, longer by spaces
    rows += [(n + 20, None, None, None, None), (n + 21, "", "", "", 0), (n + 22, " \n\t ", "en", "s1", 4)]
    rows += [(n + 23, "word " * 30_000, "en", "s2", None), (n + 24, "x", "en", "s3", 1), (n + 25, "x y", "en", None, 3)]
    rows += [(None, "an id is missing here", "en", "s1", None), rows[3], rows[3]]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
