"""Plain Python versions of the definitions that the operators are held against."""

import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def tokens(text):
    return SPACED.findall((text or "").translate(LOWER))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(x)}" if x % 3 else f"Wört{int(x)}" for x in rng.integers(0, vocabulary, n))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """documents from (doc_id, text) pairs, with columns whose names are likely to clash."""
    full = [(i, t, "en", "s", None if t is None else len(t), "x", 1, 2.0, "n", -1, 3) for i, t in rows]
    return spark.createDataFrame(full, DOCS + ", node string, count int, words double, key string, id int, pos int")
