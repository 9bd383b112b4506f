"""SimHash near-duplicate groups with BK-tree search.

Fingerprints: XXH64 (seed 42) of each three-word shingle, bitwise majority.
Documents of one fingerprint collapse to one vertex first, so copies never meet
in pairs. Distinct fingerprints are routed to shards: with radius r the 64 bits
are cut in r + 1 blocks, of which one at least is equal in any linked pair, so
a pair always meets in the shard of that block's value. Each shard holds one
BK-tree (children keyed by the integer Hamming distance to the parent) and the
search follows only edges within the radius. The trees travel to the tasks that
search them through a shuffle, not through the driver: fingerprints of all
documents are never collected. Values of a block that are too frequent are
routed by a further block of the remaining bits, so no shard grows with one
dense cluster. A shard reports its local groups as shallow trees (every vertex
has at most three links), and global components come from minimum labels with
pointer jumping, each round written to the shared folder.

Defined cases: null and word-less texts have fingerprint zero and link like any
other; null doc_ids take part but are never a component_id unless the whole
component has none; repeated rows return once each; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACED, Scratch, join_hashes, text_blocks, words

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Fingerprints aimed at per shard tree; a block value above HEAVY is routed by a further block.
SHARD_ROWS = 4096
HEAVY = 512
#: A further block repeats a fingerprint radius + 1 times, so each level takes this many times larger groups.
DEEPER = 64
#: Pairs of a query and a tree's node that are looked at together (bounds worker memory).
PAIRS = 1 << 20


def fingerprints_of(data: np.ndarray, offs: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """One unsigned 64-bit fingerprint per row of a text block."""
    low = LOWER[data]
    n = len(offs) - 1
    out = np.zeros(n, np.uint64)
    starts, ends, rows = words(low, offs, SPACED)
    if not len(starts):
        return out
    inside = SPACED[low]
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # one separator after each word stays, as a space
    place = np.cumsum(keep) - 1
    raw = np.where(inside, low, 32).astype(np.uint8)[keep].tobytes()
    starts, ends = place[starts], place[ends - 1] + 1
    counts = np.bincount(rows, minlength=n)
    last = np.cumsum(counts)
    k = np.minimum(counts, shingle)
    at = np.flatnonzero(np.arange(len(starts)) + k[rows] <= last[rows])
    h = np.fromiter(map(xxhash.xxh64_intdigest, [raw[s:e] for s, e in zip(starts[at].tolist(), ends[at + k[rows[at]] - 1].tolist(), strict=True)], _seeds()), np.uint64, len(at))
    of = rows[at]
    here = np.flatnonzero(counts)
    begin = np.searchsorted(of, here)
    size = np.diff(np.append(begin, len(of)))
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    major = (total * 2 > size[:, None]).astype(np.uint8)
    out[here] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _seeds():
    while True:
        yield SEED


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offs in text_blocks(batches, "__text"):
        fp = fingerprints_of(data, offs)
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(fp.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, *keep) -> DataFrame:
    """doc_id (or the given columns) and fp, the fingerprint as a signed long."""
    df = docs.select(*(keep or [F.col("doc_id").cast("long").alias("doc_id")]), F.col("text").cast("string").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1])
    return df.mapInArrow(_fingerprint_rows, f"{kinds}, fp bigint")


class BKTree:
    """A BK-tree over distinct fingerprints; all operations work level by level."""

    def __init__(self, values: np.ndarray):
        self.values = values
        edges, nodes = [], []
        order = np.arange(len(values))
        group = np.zeros(len(values), np.int64)
        while len(order):
            head = np.concatenate([[True], group[1:] != group[:-1]])
            pivots = order[head]
            which = np.cumsum(head) - 1
            rest = ~head
            order, which = order[rest], which[rest]
            distance = np.bitwise_count(values[order] ^ values[pivots[which]]).astype(np.int64)
            key = pivots[which] * 128 + distance
            sort = np.lexsort((order, key))
            order, group = order[sort], key[sort]
            lead = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
            edges.append(group[lead])
            nodes.append(order[lead])
        keys = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        sort = np.argsort(keys, kind="stable")
        #: parent * 128 + distance, sorted, and the child each names; the root is node 0.
        self.keys = keys[sort]
        self.children = (np.concatenate(nodes) if nodes else np.zeros(0, np.int64))[sort]

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query index, value index) of all pairs within the radius."""
        if not len(self.values):
            return
        q = np.arange(len(queries))
        node = np.zeros(len(queries), np.int64)
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            lo = np.searchsorted(self.keys, node * 128 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.keys, node * 128 + d + radius, side="right")
            n = hi - lo
            q = np.repeat(q, n)
            node = self.children[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(q))]


def _unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest labels of connected indices after adding the links a-b."""
    while True:
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            return labels
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            step = labels[labels]
            if (step == labels).all():
                break
            labels = step


def shard_links(values: np.ndarray, radius: int = RADIUS, at_once: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect exactly what the pairs within the radius connect, at most three per value."""
    values = np.unique(values)
    tree = BKTree(values)
    at_once = max(1, min(at_once, PAIRS // max(1, len(values))))
    labels = np.arange(len(values))
    for i in range(0, len(values), at_once):
        for q, node in tree.search(values[i : i + at_once], radius):
            other = node != q + i
            labels = _unite(labels, q[other] + i, node[other])
    order = np.argsort(labels, kind="stable")
    first = np.searchsorted(labels[order], labels[order])
    rank = np.arange(len(order)) - first
    child = np.flatnonzero(rank > 0)
    return values[order[child]], values[order[first[child] + (rank[child] - 1) // 2]]


def _search_shards(radius: int):
    def links(parts: list[np.ndarray]) -> pa.RecordBatch:
        u, v = shard_links(np.concatenate(parts).view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; a shard may go on over several batches."""
        held, current = [], None
        for batch in batches:
            shard, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = np.flatnonzero(np.diff(shard)) + 1
            for part, s in zip(np.split(fp, cuts), shard[np.concatenate([[0], cuts])] if len(shard) else [], strict=False):
                if s != current and held:
                    yield links(held)
                    held = []
                current = s
                held.append(part)
        if held:
            yield links(held)

    return run


def _cut_bits(rest: int, blocks: int) -> list[int]:
    """The set bits of a mask in so many runs of about equal size."""
    bits = [x for x in range(64) if rest >> x & 1]
    edges = [len(bits) * i // blocks for i in range(blocks + 1)]
    return [sum(1 << x for x in bits[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def _route(radius: int):
    """Each row (fp, key, rest) once per block of the bits in `rest`; linked pairs agree in one block at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, key, rest = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
            for mask in np.unique(rest):
                at = np.flatnonzero(rest == mask)
                for j, block in enumerate(_cut_bits(int(mask), radius + 1)):
                    value = join_hashes(key[at], np.full(len(at), j, np.uint64), fp[at] & np.uint64(block))
                    columns = [fp[at], value, np.full(len(at), int(mask) & ~block, np.uint64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=["fp", "key", "rest"])

    return run


def links(spark: SparkSession, distinct: DataFrame, rows: int, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """u, v: a sparse set of links with the components of all pairs within the radius."""
    dense = distinct.select("fp", F.lit(0).cast("long").alias("key"), F.lit(-1).cast("long").alias("rest"))
    groups, bits, most = [], 64, HEAVY
    while True:
        keyed = dense.mapInArrow(_route(radius), "fp bigint, key bigint, rest bigint")
        # The blocks agree here, so the bits outside them differ in at most `radius` places: cut them again.
        bits -= bits // (radius + 1)
        heavy = scratch.cut(keyed.groupBy("key").count().filter(F.col("count") > most).select("key"))
        most *= DEEPER
        if bits <= radius or not heavy.limit(1).count():
            groups.append(keyed)
            break
        groups.append(keyed.join(heavy, "key", "left_anti"))
        dense = keyed.join(heavy, "key", "left_semi").select("fp", "key", "rest")
    shards = max(1, round(rows * (radius + 1) / SHARD_ROWS))
    routed = reduce(DataFrame.unionByName, groups).select(F.pmod("key", F.lit(shards)).alias("shard"), "fp")
    return routed.repartition("shard").sortWithinPartitions("shard").mapInArrow(_search_shards(radius), "u bigint, v bigint")


def smallest_labels(edges: DataFrame, names: DataFrame, scratch: Scratch) -> DataFrame:
    """v, name: the smallest name of the component of every vertex that has an edge.

    edges: u, v (each once, any direction); names: v, name (a struct that ends
    in the vertex itself, field v). Minimum over neighbours, then a jump to the
    label's label, until nothing changes.
    """
    both = scratch.cut(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = scratch.cut(both.select(F.col("u").alias("v")).distinct().join(names, "v"))
    while True:
        seen = both.join(labels, "v").select(F.col("u").alias("v"), "name", F.lit(None).cast(labels.schema["name"].dataType).alias("old"))
        lowest = scratch.cut(labels.select("v", "name", F.col("name").alias("old")).unionByName(seen).groupBy("v").agg(F.min("name").alias("name"), F.min("old").alias("old")))
        jump = lowest.select(F.col("v").alias("at"), F.col("name").alias("further"))
        after = scratch.cut(lowest.join(jump, F.col("name.v") == F.col("at")).select("v", F.least("name", "further").alias("name"), "old"))
        moved = after.filter(F.col("name.v") != F.col("old.v")).limit(1).count()
        scratch.drop(labels, lowest)
        labels = after
        if not moved:
            scratch.drop(both)
            return labels.select("v", "name")


def components(spark: SparkSession, docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (signed long), component_id: the smallest doc_id reachable over links."""
    scratch = Scratch(spark)
    marked = scratch.cut(fingerprints(docs))
    grouped = _grouped(spark, marked, scratch, radius)
    return marked.join(grouped, "fp").select("doc_id", "fp", "component_id")


def _grouped(spark: SparkSession, marked: DataFrame, scratch: Scratch, radius: int) -> DataFrame:
    """fp, component_id, root (one fingerprint of the component) of every distinct fingerprint."""
    distinct = scratch.cut(marked.groupBy("fp").agg(F.min("doc_id").alias("doc")))
    edges = scratch.cut(links(spark, distinct, distinct.count(), scratch, radius))
    names = distinct.select(F.col("fp").alias("v"), F.struct(F.col("doc").isNull().alias("none"), F.col("doc"), F.col("fp").alias("v")).alias("name"))
    labels = smallest_labels(edges, names, scratch)
    return distinct.join(labels, F.col("fp") == F.col("v"), "left").select("fp", F.when(F.col("v").isNull(), F.col("doc")).otherwise(F.col("name.doc")).alias("component_id"), F.coalesce("name.v", "fp").alias("root"))


def keep_one(spark: SparkSession, docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents, one of each component: that of the smallest doc_id.

    Rows without a doc_id, or that share the smallest doc_id, tell apart by
    their text and other columns; one of them stays. All columns come back.
    """
    scratch = Scratch(spark)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    if "map<" in docs.schema.simpleString():
        whole = F.to_json(whole)  # maps have no hash of their own
    marked = scratch.cut(fingerprints(docs, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole).alias("row")))
    grouped = _grouped(spark, marked, scratch, radius)
    lead = marked.join(grouped, "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = scratch.cut(lead.groupBy("root", "row").count().groupBy("root").agg(F.min(F.struct("row", "count")).alias("one")).select("one.row", "one.count"))
    names = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*names, F.xxhash64(whole).alias("__row"))
    # A merge join at every size: whether the kept rows could be broadcast depends on the input, and they grow with it.
    names_of = lambda t: kept.filter(t).select(F.col("row").alias("__row")).hint("merge")
    stay = rows.join(names_of("count = 1"), "__row", "left_semi")
    if kept.filter("count > 1").limit(1).count():  # rows equal in every column: one of them
        stay = stay.unionByName(rows.join(names_of("count > 1"), "__row", "left_semi").dropDuplicates(["__row"]))
    return stay.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
