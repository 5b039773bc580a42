"""Documents for small tests: nulls, empty, ties, repeats, long texts, odd white space, clashing column names."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("fp", "size", "kept", "bucket")]  # names that operators use inside
)


def prose(rng: random.Random, n: int) -> str:
    sounds = ["an", "the", "re", "é", "ing", "on", "ou", "st", "ß", "tion", "er"]
    words = ["".join(rng.choices(sounds, k=rng.randint(1, 4))) for _ in range(n)]
    return "".join(w + rng.choice([" ", " ", " ", "\n", ", ", "  "]) for w in words)


def documents(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(60, 300)) for _ in range(30)]
    texts: list[str | None] = [None, "", " \n\t ", "one", "One two", "one two three", "The\x0bend\x0cof\rit", "a b c\x85d", "<|endoftext|> it's <|ENDOFTEXT|>", "word " * 400, "x#*$%&|<>" * 30]
    texts += base + [base[0], base[0], base[1].upper(), base[2] + " tail", base[3].replace(" ", "\n", 1)]
    texts += [" ".join(w for w in base[4].split() if w != base[4].split()[7]), prose(rng, 6000), "line\nline\nother\nline\n\n\nother"]
    rows = [(i * 7 % 1009, t, "en", rng.choice(["a", "b", "B", "é", None]), len(t or ""), "x", "y", "z", "q") for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], (None, base[5], None, None, None, None, None, None, None)]
    return rows
