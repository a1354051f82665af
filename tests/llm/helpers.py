"""Small awkward tables for the operators, and word rules written out."""

from __future__ import annotations

import random
import re

LONG = "ab cd " * 40_000
EXTRA = "id long, t string, score double, label int, rank int, part int, size long, key string, rep long, lang_pred string, path string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def documents(spark, rows):
    """(doc_id, text, lang, source) rows with more columns of names that the operators use themselves."""
    full = [(*r, None if r[1] is None else len(r[1]), -1, "x", 9.0, 7, 3, 2, 1, "k", 5, "zz", "/p") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward(spark):
    return documents(
        spark,
        [
            (1, None, "en", "a"),
            (2, "", "en", "a"),
            (3, " \n\t ", None, None),
            (4, "one two three four five six", "en", "b"),
            (4, "one two three four five six", "en", "b"),
            (5, "One  two\nthree▁four", "de", None),
            (6, LONG, "en", "a"),
            (7, "é ß 日本語 \U0001f600 \x00 <s> <|endoftext|>", "fr", ""),
            (None, "no id here", "en", "b"),
            (8, "12 34 !!", "en", "b"),
        ],
    )


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def sentence(rng: random.Random, n: int, vocabulary: int = 5000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
