"""Numpy arrays packed into one binary value: byte planes, then zstandard.

Shuffles of packed arrays move far fewer bytes than one row per element. Such
values travel in rows (kind, key, chunk, blob) and meet by key.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import trim

COLUMNS = "kind string, key bigint, chunk bigint, blob binary"
_TYPES = {"kind": pa.string(), "key": pa.int64(), "chunk": pa.int64(), "blob": pa.binary()}

#: u6: eight-byte values of which six bytes are stored.
_KINDS = ("u1", "u2", "u4", "u6", "u8", "i4", "i8", "f8")
#: Added to the kind of arrays that are stored as differences.
_STEPS = 64


def _smallest(top: int) -> str:
    return "u1" if top < 1 << 8 else "u2" if top < 1 << 16 else "u4" if top < 1 << 32 else "u8"


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned integers shrink to the smallest width that holds them, sorted ones to their differences."""
    head, body = [struct.pack("<B", len(arrays))], []
    for a in arrays:
        steps = 0
        if a.dtype.kind == "u" and len(a):
            if len(a) > 1 and (a[1:] >= a[:-1]).all():
                steps, a = _STEPS, np.diff(a, prepend=a.dtype.type(0))
            top = int(a.max())
            a = a.astype(_smallest(top))
        kind = a.dtype.str[1:]
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T
        if kind == "u8" and len(a) and top < 1 << 48:
            kind, planes = "u6", planes[:6]
        head.append(struct.pack("<BQ", steps + _KINDS.index(kind), len(a)))
        body.append(planes.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + body))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = raw[0]
    at = 1 + 9 * n
    out = []
    for i in range(n):
        kind, size = struct.unpack_from("<BQ", raw, 1 + 9 * i)
        name = _KINDS[kind % _STEPS]
        dtype, stored = np.dtype("u8" if name == "u6" else name), int(name[1])
        planes = np.zeros((size, dtype.itemsize), np.uint8)
        planes[:, :stored] = np.frombuffer(raw, np.uint8, size * stored, at).reshape(stored, size).T
        a = planes.reshape(-1).view(dtype) if size else np.zeros(0, dtype)
        if kind >= _STEPS:
            a = np.cumsum(a, dtype=np.uint64)
            a = a.astype(_smallest(int(a[-1])))
        out.append(a)
        at += size * stored
    return out


def blob_rows(rows: list[tuple], names: tuple = ("kind", "key", "chunk", "blob")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), _TYPES[n]) for c, n in zip(zip(*rows, strict=True), names, strict=True)], names=list(names))


def batches_of(rows: list[tuple], at_once: int) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(rows), at_once):
        yield blob_rows(rows[lo : lo + at_once])


def slices(key: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of the runs of a sorted array."""
    cut = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b > a:
            yield int(key[a]), a, b


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)


def grouped(batches: Iterator[pa.RecordBatch], columns: tuple) -> Iterator[tuple[int, list[tuple]]]:
    """(key, rows) of batches sorted by key, the first column."""
    current, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns), strict=True):
            if row[0] != current and held:
                yield current, held
                held = []
                trim()
            current = row[0]
            held.append(row[1:])
    if held:
        yield current, held
        trim()


def by_part(df: DataFrame, parts: int, first: int = 0) -> DataFrame:
    """Rows keyed by the numbers of `parts` parts from `first` on: each part in a Spark partition of its own."""
    return _met(df, parts, F.col("key") - first)


def by_key(df: DataFrame, parts: int) -> DataFrame:
    """Rows of any keys, spread by hash."""
    return _met(df, parts, F.pmod(F.xxhash64("key"), F.lit(parts)))


def _met(df: DataFrame, parts: int, place: Column) -> DataFrame:
    return df.repartitionById(parts, place.cast("int")).sortWithinPartitions("key")
