"""Language identification by compression.

Every language has a raw-content zstandard dictionary made of slices of its
texts. A text is lower-cased, cut into chunks, and each chunk is compressed
with each language's dictionary; the language of the smallest total is chosen.
Chunks keep the evidence even over a long text, as a compressor would otherwise
learn the text itself. A prediction is rejected when the runner-up's total is
within a narrow margin.

Training reads a bounded sample: per language one slice of each of SAMPLE_DOCS
documents, the first by hash in each of SAMPLE_DOCS hash buckets (a combining
aggregate of fixed width), up to DICT_BYTES.

Defined cases: null texts and texts without a letter (Unicode category L) are
`und` with score 0; a text of any length counts whole, chunk by chunk; null
languages and null ids do not train, nor does a language whose sampled texts
hold no word; without any training text everything is `und`; equal totals go to
the first language in code-point order; rows come back once each; more than
MAX_LANGS labels raise an error rather than dropping some.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

SAMPLE_DOCS = 64
SLICE_CHARS = 2000
DICT_BYTES = 64 << 10
#: Raw dictionaries of fewer bytes are void to zstandard; shorter samples repeat up to this.
MIN_DICT = 8
MAX_LANGS = 512
CHUNK_BYTES = 2048
LEVEL = 6
#: Bytes of difference that count as one unit of evidence in the score.
SCALE = 3.0
#: Margins (of the smallest total, and in bytes) under which a prediction is rejected.
NARROW, NARROW_BYTES = 0.01, 2

#: Holds all letters, and numerals such as one half.
_WORD = re.compile(r"[^\W\d_]")
_REST = re.compile(r"[\W\d_]+")


def normal(text: str) -> bytes:
    """Lower-cased words with single spaces: what tells languages apart, without marks and digits."""
    return _REST.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _WORD.finditer(text))


class Model:
    """Dictionaries by language; compressors are made where the model is used."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.dictionaries = dict(sorted(dictionaries.items()))
        self._made = None

    def __getstate__(self):
        return {"dictionaries": self.dictionaries, "_made": None}

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        if self._made is None:
            self._made = []
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            for raw in self.dictionaries.values():
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=params)
                self._made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))
        return self._made

    def totals(self, text: str) -> list[int]:
        """Compressed bytes of the whole text by language."""
        raw = normal(text)
        chunks = [raw[i : i + CHUNK_BYTES] for i in range(0, len(raw), CHUNK_BYTES)]
        return [sum(len(c.compress(x)) for x in chunks) for c in self.compressors()]

    def predict(self, text: str | None) -> tuple[str, float, bool, float]:
        """(language, score, rejected, margin)."""
        if not text or not self.dictionaries or not has_letter(text):
            return "und", 0.0, True, 0.0
        totals = np.array(self.totals(text), np.float64)
        best = int(totals.argmin())
        rest = np.delete(totals, best)
        gap = float(rest.min() - totals[best]) if len(rest) else float("inf")
        margin = gap / totals[best]
        score = float(1 / np.exp(-(totals - totals[best]) / SCALE).sum())
        return list(self.dictionaries)[best], score, gap < NARROW_BYTES or margin < NARROW, margin


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES) -> Model:
    """Dictionaries from rows whose crc32(id) mod 4 is not 2."""
    known = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("body"))
    known = known.filter("id is not null and lang is not null and body is not null").filter(~held_out(4, 2, "id"))
    h = F.xxhash64("id", F.lit(5))
    picked = known.select("lang", "id", h.alias("h")).groupBy("lang", F.pmod("h", F.lit(sample_docs)).alias("b")).agg(F.min_by("id", "h").alias("id"))
    rows = picked.limit((MAX_LANGS + 1) * sample_docs).select("lang", "id").collect()
    langs = {r["lang"] for r in rows}
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not rows:
        return Model({})
    spark = docs.sparkSession
    chosen = spark.createDataFrame(rows, "lang string, id long")  # at most MAX_LANGS * SAMPLE_DOCS ids
    room = F.greatest(F.char_length("body") - SLICE_CHARS, F.lit(0)) + 1
    part = F.substring(F.col("body"), 1 + F.pmod(F.xxhash64("id", F.lit(6)), room).cast("int"), F.lit(SLICE_CHARS))
    found = known.join(F.broadcast(chosen), ["lang", "id"]).select("lang", "id", part.alias("part")).groupBy("lang", "id").agg(F.min("part").alias("part"))
    texts: dict[str, list] = {}
    for r in found.toLocalIterator():
        texts.setdefault(r["lang"], []).append((r["id"] * 2654435761 % (1 << 32), r["id"], r["part"]))
    out = {}
    for lang, parts in texts.items():
        raw = normal("\n".join(p for _, _, p in sorted(parts)))
        if raw.strip():
            out[lang] = (raw * -(-MIN_DICT // len(raw)))[-dict_bytes:]
    return Model(out)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected, margin of every document."""
    df = docs.select("doc_id", held_out(4, 2).alias("held_out"), F.col("text").cast("string").alias("__text"))
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.predict(v.as_py()) for v in batch.column(2)]
            lang, score, rejected, margin = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_()), pa.array(margin, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected", "margin"],
            )

    return df.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean, margin double")
