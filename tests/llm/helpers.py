"""Small tables with every odd case, and plain Python versions of what the operators compute."""

import re

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, token string, sid string, node string, key string, part int, label string, _id string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    """Rows of (doc_id, text, lang, source) with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 1, "x", None, "n", "k", 3, "y", "z") for i, t, lang, s in rows], DOCS)


def prose(seed, n, vocabulary=4000):
    import random
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


ODD = [
    (None, "a text without an id but with some words in it", "en", "s1"), (1, None, "en", "s1"), (2, "", None, None), (3, " \t\n ", "en", "s2"), (4, "one", "en", None),
    (5, "same words here and there again", "en", "s1"), (6, "same words here and there again", "en", "s2"), (6, "same words here and there again", "en", "s2"),
    (7, "x" * 50_000, "en", "s1"), (8, prose(8, 30_000), "en", "s3"), (9, "héllo wörld ſ K 漢字 😀 end", "de", "s3"), (-5, "negative id with a few words", "fr", ""),
]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, k=5):
    w = words(text)
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=repr)


__all__ = ["DOCS", "ODD", "docs", "prose", "pytest", "shingles", "sorted_rows", "words"]
