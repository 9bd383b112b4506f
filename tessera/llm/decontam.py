"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Benchmark items are cut into windows of `window` consecutive words (A-Z lower-
cased, words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`; a shorter item is one
window). The windows' 64-bit hashes and texts go to the tasks; each document's
token windows are looked up by hash, and every hash hit is verified against the
window's words before it counts. No shuffle takes place.

The set is broadcast in blocks of at most `block_bytes` of benchmark text, one
block alive at a time: before the next block's set is made, the rows with the
hits so far are written to the shared folder, and the next pass merges its hits
with those. A benchmark of one block (all known ones) takes one map-only pass.

Defined cases: null or empty texts have no words, an empty documents table gives
no row, texts are scanned whole at any length; items without words or with
null text have no window; an item with a null item_id marks hits but is named
in no list; items with one id count once; an empty benchmark hits nothing;
other columns, whatever their names, pass through `remove` untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, Scratch, mix, text_blocks, word_hashes, words

WINDOW = 10
#: Benchmark text sent to the tasks at once.
BLOCK_TEXT_BYTES = 4 << 20

_STEP = 0xD1342543DE82EF95 | 1
_BACK = pow(_STEP, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.full(max(n, 1), base, np.uint64)]).cumprod(dtype=np.uint64)


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the window of `length` words starting at each word that has one."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _powers(_STEP, len(hashes))[: len(hashes)], out=total[1:])
    return mix((total[length:] - total[:n]) * _powers(_BACK, n)[:n] + np.uint64(length))


class WindowSet:
    """The windows of some benchmark items: by length, sorted hashes, words and items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        found: dict[int, dict[bytes, set]] = {}
        hashes: dict[bytes, int] = {}
        for item, text in items:
            buf = np.frombuffer((text or "").encode(), np.uint8)
            low = LOWER[buf]
            starts, ends, _ = words(low, np.array([0, len(low)]), ALNUM)
            if not len(starts):
                continue
            k = min(window, len(starts))
            raw = low.tobytes()
            tokens = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            for i, h in enumerate(window_hashes(word_hashes(low, starts, ends), k).tolist()):
                key = b" ".join(tokens[i : i + k])
                hashes[key] = h
                found.setdefault(k, {}).setdefault(key, set()).add(item)
        self.by_length = {}
        for k, group in found.items():
            keys = sorted(group, key=hashes.__getitem__)
            near = np.zeros(max(1 << 18, 1 << (8 * len(keys)).bit_length()), bool)
            values = np.array([hashes[x] for x in keys], np.uint64)
            near[(values & np.uint64(near.size - 1)).astype(np.int64)] = True
            self.by_length[k] = (values, near, keys, [sorted(x for x in group[key] if x is not None) for key in keys])

    def hits(self, low: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, set], np.ndarray, np.ndarray]:
        """Of a block: row of each word, which words are hit, items by row, word starts and ends."""
        starts, ends, rows = words(low, offs, ALNUM)
        marks = np.zeros(len(starts) + 1, np.int64)
        items: dict[int, set] = {}
        if len(starts) and self.by_length:
            hashed = word_hashes(low, starts, ends)
            raw = None
            for k, (values, near, keys, names) in self.by_length.items():
                h = window_hashes(hashed, k)
                if not len(h):
                    continue
                at = np.flatnonzero(near[(h & np.uint64(near.size - 1)).astype(np.int64)])
                at = at[rows[at] == rows[at + k - 1]]
                slot = np.searchsorted(values, h[at])
                slot[slot == len(values)] = 0
                same = values[slot] == h[at]
                raw = low.tobytes() if raw is None and same.any() else raw
                for i, j in zip(at[same].tolist(), slot[same].tolist(), strict=True):
                    text = b" ".join([raw[s:e] for s, e in zip(starts[i : i + k].tolist(), ends[i : i + k].tolist(), strict=True)])
                    while j < len(keys) and values[j] == h[i]:  # equal hashes stand together
                        if keys[j] == text:
                            marks[i] += 1
                            marks[i + k] -= 1
                            items.setdefault(int(rows[i]), set()).update(names[j])
                        j += 1
        return rows, np.cumsum(marks[:-1]) > 0, items, starts, ends


def window_sets(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_TEXT_BYTES) -> Iterator[WindowSet]:
    """The benchmark's windows in blocks of bounded size."""
    bench = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("body")).filter("body is not null")
    size = bench.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    for b in range(blocks):
        part = bench if blocks == 1 else bench.filter(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == b)
        yield WindowSet([tuple(r) for r in part.collect()], window)


_CARRY = [pa.field("__words", pa.int64()), pa.field("__hit", pa.binary()), pa.field("__items", pa.list_(pa.string()))]


def _marker(sets: WindowSet, first: bool):
    """Adds (or merges into) the carried columns: word count, bits of hit words, items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in text_blocks(batches, "__text"):
            rows, hit, items, _, _ = sets.hits(LOWER[data], offs)
            n = batch.num_rows
            counts = np.bincount(rows, minlength=n)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            some = np.bincount(rows, weights=hit, minlength=n) > 0
            bits = [np.packbits(hit[bounds[i] : bounds[i + 1]]).tobytes() if some[i] else b"" for i in range(n)]
            names = [sorted(items.get(i, ())) for i in range(n)]
            columns = [batch.column(i) for i in range(batch.num_columns)]
            if not first:
                before = columns[-2].to_pylist(), columns[-1].to_pylist()
                bits = [_either(a or b"", b) for a, b in zip(before[0], bits, strict=True)]
                names = [sorted({*(a or ()), *b}) for a, b in zip(before[1], names, strict=True)]
                columns = columns[:-3]
            columns += [pa.array(counts, pa.int64()), pa.array(bits, pa.binary()), pa.array(names, pa.list_(pa.string()))]
            keep = batch.schema.names if first else batch.schema.names[:-3]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(f.name for f in _CARRY)])

    return run


def _either(a: bytes, b: bytes) -> bytes:
    if not a or not b:
        return a or b
    return np.bitwise_or(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)).tobytes()


def _marked(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, keep: list) -> DataFrame:
    """Columns `keep`, the text as __text, and the carried columns."""
    df = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + ["__words bigint", "__hit binary", "__items array<string>"]
    scratch, before = Scratch(docs.sparkSession), None
    for i, sets in enumerate(window_sets(benchmark, window, block_bytes)):
        if i:
            written = scratch.cut(df)
            scratch.drop(before)
            df = before = written
        df = df.mapInArrow(_marker(sets, i == 0), ", ".join(kinds))
    return df


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_TEXT_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated."""
    df = _marked(docs, benchmark, window, block_bytes, [F.col("doc_id")])
    return df.select(
        "doc_id",
        F.col("__words").alias("n_words"),
        _ones("__hit").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.col("__items").alias("items"),
        F.sha2(F.array_join("__items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.octet_length("__hit") > 0).alias("contaminated"),
    )


def _ones(column: str):
    """Number of set bits of a binary column: those of its hex digits."""
    digits = F.hex(column)
    total = F.lit(0)
    for n, chars in ((1, "1248"), (2, "3569AC"), (3, "7BDE"), (4, "F")):
        total = total + n * F.length(F.regexp_replace(digits, f"[^{chars}]", ""))
    return total.cast("long")


def remove(docs: DataFrame, benchmark: DataFrame, spans: bool = False, window: int = WINDOW, block_bytes: int = BLOCK_TEXT_BYTES) -> DataFrame:
    """Drops contaminated documents, or with spans=True cuts only the hit words out of their texts.

    All columns of docs come back, in order and with their names and types.
    """
    names = docs.columns
    inner = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    df = _marked(docs, benchmark, window, block_bytes, inner)
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    if not spans:
        return df.filter(F.octet_length("__hit") == 0).select(*kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    text = names.index("text")
    cut = df.mapInArrow(_cutter, schema)
    return cut.select(*(F.col("__text").alias(c) if i == text else k for i, (c, k) in enumerate(zip(names, kept, strict=True))))


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offs in text_blocks(batches, "__text"):
        place = batch.schema.get_field_index("__text")
        bits = batch.column(batch.schema.get_field_index("__hit")).to_pylist()
        texts = batch.column(place).to_pylist()
        low = LOWER[data]
        starts, ends, rows = words(low, offs, ALNUM)
        bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        for i, mask in enumerate(bits):
            if not mask:
                continue
            a, b = bounds[i], bounds[i + 1]
            hit = np.unpackbits(np.frombuffer(mask, np.uint8), count=b - a).astype(bool)
            keep = np.ones(offs[i + 1] - offs[i], bool)
            edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                keep[starts[a + s] - offs[i] : ends[a + e - 1] - offs[i]] = False
            texts[i] = data[offs[i] : offs[i + 1]][keep].tobytes().decode()
        columns = [pa.array(texts, pa.string()) if j == place else batch.column(j) for j in range(batch.num_columns)]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
