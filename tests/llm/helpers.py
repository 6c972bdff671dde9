"""Small tables for the operators' tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs(spark, rows, schema=DOCS):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], schema)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    words = ["".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(2, 7))) for _ in range(vocabulary)]
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(n))


ODD = [(None, None), (1, None), (2, ""), (3, " \t\n"), (4, "é́x 😀"), (5, "a"), (5, "a"), (6, "a "), (7, "b " * 30_000)]


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
