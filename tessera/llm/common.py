"""Shared helpers: shared scratch tables, Arrow text blocks, vectorised words."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    _malloc_trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):
    _malloc_trim = None

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Text bytes handled at once by the vectorised code (bounds worker memory).
BLOCK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares (spark.checkpoint.dir).

    Where the setting is missing, a session on one machine (unit tests) makes a
    temporary folder once and remembers it; a cluster must name its folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tessera.scratch.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("tessera.scratch.dir", path)
    return path.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder that cut lineage between jobs.

    A written table survives the loss of any executor, unlike cached blocks.
    What is not dropped before goes when the driver ends, as the returned
    DataFrame may be read until then.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
        self.n = 0

    def cut(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """Writes df (in folders by the column `by`) and returns a reader of the written rows."""
        self.n += 1
        path = f"{self.root}/{self.n:04d}"
        # The write's shuffle files go with its end: the table is whole, and no later plan uses them.
        conf, given = self.spark.conf, self.spark.conf.get(_CLEANUP, "false")
        conf.set(_CLEANUP, "true")
        try:
            (df.write.partitionBy(by) if by else df.write).parquet(path)
        finally:
            conf.set(_CLEANUP, given)
        if self.n == 1:
            root = self._path(self.root)
            root.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(root)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessera_path = path
        return out

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def drop(self, *tables: DataFrame | None, kind: str | None = None) -> None:
        """Deletes tables made by cut() that no later plan reads, or their folders of one kind."""
        for table in tables:
            path = getattr(table, "_tessera_path", None)
            if path:
                where = self._path(f"{path}/kind={kind}" if kind else path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def sweep(self) -> None:
        """Lets Spark drop the shuffle files of finished steps, which it does when their plans are collected."""
        gc.collect()
        self.spark._jvm.System.gc()


def trim() -> None:
    """Gives freed memory of a Python worker back to the system, where the C library can."""
    if _malloc_trim is not None:
        _malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where there are fewer input splits than those, which bounds what is moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def held_out(modulus: int, remainder: int, column: str = "doc_id"):
    """crc32(id as text) mod modulus = remainder; false where the id is null."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Splits batches by bytes: (rows, UTF-8 bytes of all texts, offsets by row).

    Null texts become empty. One text longer than the limit is a block of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        if col.null_count:
            col = col.fill_null(b"")
        n = len(col)
        offs = np.frombuffer(col.buffers()[1], dtype=np.int64, count=n + 1 + col.offset)[col.offset :]
        raw = col.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
            to = min(to, n)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


def byte_mask(chars: str | bytes, invert: bool = False) -> np.ndarray:
    """A 256-entry boolean table of byte values."""
    mask = np.zeros(256, dtype=bool)
    mask[list(chars.encode() if isinstance(chars, str) else chars)] = True
    return ~mask if invert else mask


#: ASCII A-Z to a-z on bytes; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words split at ASCII white space, [^\x20\x09-\x0D]+.
SPACED = byte_mask(b" \t\n\x0b\x0c\r", invert=True)
#: Bytes of alphanumeric words, [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def words(low: np.ndarray, offs: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word of a block; words never span rows."""
    inside = mask[low]
    n = len(low)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = True
    last[cuts - 1] = True
    starts = np.flatnonzero(inside & first)
    ends = np.flatnonzero(inside & last) + 1
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(starts, offs)))
    return starts, ends, rows


_MULT = 0x9E3779B97F4A7C15 | 3
_INV = pow(_MULT, -1, 1 << 64)
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 64, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + (BLOCK_BYTES >> 2))
        _powers[:] = [np.concatenate([[np.uint64(1)], np.full(size, m, np.uint64)]).cumprod(dtype=np.uint64) for m in (_MULT, _INV)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from one prefix sum over the block."""
    up, down = _power_tables(len(low) + 1)
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(_BYTES[low] * up[: len(low)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def join_hashes(*parts: np.ndarray) -> np.ndarray:
    """An order-sensitive 64-bit hash of aligned hash arrays."""
    out = np.full(len(parts[0]), 0x243F6A8885A308D3, np.uint64)
    for p in parts:
        out = mix(out * np.uint64(0xD1342543DE82EF95) + p)
    return out
