"""Small inputs with every awkward case, and plain word splitting."""

from __future__ import annotations

import re
import zlib

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_hit string, fp string, c0 int, `__row` int, part int"


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def crc(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def documents(spark, texts, ids=None, langs=None, sources=None):
    """A documents table with extra columns whose names clash with those the operators make."""
    n = len(texts)
    ids = ids if ids is not None else list(range(n))
    rows = [(ids[i], texts[i], langs[i] if langs else "en", sources[i] if sources else "s", len(texts[i] or ""), 0.5, "x", None, 1, 2, i) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


LONG = " ".join(f"word{i % 977} über" for i in range(250_000))
AWKWARD = [None, "", " \n\t ", "one", "one two", "Ünï çødé ﬀ 😀 text", "same text here again", "same text here again", LONG, "!!! ... ???"]
