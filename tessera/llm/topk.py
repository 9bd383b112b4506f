"""Exact top-k inner-product search by the threshold algorithm.

Vectors become integers, floor(256 x). Candidates stream through in shards of
bounded size. A shard sorts one list per dimension; a query walks all lists in
step from the end that its component favours, scores every row it meets by
random access, and stops once the bound (the inner product with the last values
seen) cannot beat its kth score. The kth score carries over from shard to shard
of a task, so later shards stop sooner. Each task sends k rows per query, and a
ranking window per query merges them.

Queries are read in blocks of at most QUERY_ROWS distinct rows. One block is
alive at a time: it is sent to the tasks, run against all rows, and its result
written to the shared folder before the next block is read.

Each row asks for itself: rows that are equal in id and vector ask once and get
the same answer, so the search finds k + 1 rows, the query's own among them if
it ranks so high, and that one is taken out.

Defined cases: vectors that are null or hold a null or non-finite component,
and rows with a null vec_id, take no part; vectors of different lengths are not
compared; repeated rows each ask and each count as candidates; ties go to the
smaller vec_id; a query without candidates returns no row; components beyond
the 64-bit range, and result scores beyond it, raise an error, and products in
between are computed exactly; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

K = 5
SCALE = 256
#: Queries of one pass, and candidates whose lists are sorted together.
QUERY_ROWS = 4096
SHARD_ROWS = 8192


def integers(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the integer vector, of the rows that take part."""
    value = F.col("embedding").cast("array<double>")
    fine = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("e"), fine.alias("fine")).filter("vec_id is not null and e is not null and fine")
    fits = F.forall("e", lambda x: F.abs(x * scale) < 2.0**63)
    fine = F.when(fits, F.transform("e", lambda x: F.floor(x * scale).cast("long"))).otherwise(F.raise_error(F.lit("a vector component is beyond the 64-bit range")))
    return rows.select("vec_id", fine.alias("v"))


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, vectors: np.ndarray, k: int):
        self.vectors, self.k = vectors, k
        self.scores = np.full((len(vectors), k), np.iinfo(np.int64).min, np.int64)
        self.found = np.full((len(vectors), k), np.iinfo(np.int64).max, np.int64)
        self.filled = np.zeros(len(vectors), np.int64)

    def kth(self, q: int) -> int | None:
        return int(self.scores[q, -1]) if self.filled[q] >= self.k else None

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merges new candidates."""
        if (low := self.kth(q)) is not None:
            keep = scores >= low
            if not keep.any():
                return
            scores, ids = scores[keep], ids[keep]
        n = self.filled[q]
        s = np.concatenate([self.scores[q, :n].astype(scores.dtype), scores])
        i = np.concatenate([self.found[q, :n], ids])
        order = np.lexsort((i, -s))[: self.k]
        m = len(order)
        if s.dtype == object and not all(-(1 << 63) <= x < 1 << 63 for x in s[order]):
            raise OverflowError("a score is beyond the 64-bit range")
        self.scores[q, :m], self.found[q, :m], self.filled[q] = s[order].astype(np.int64), i[order], m


def search_shard(best: Best, ids: np.ndarray, vectors: np.ndarray) -> None:
    """Runs every query of `best` through one shard's sorted lists."""
    n, dims = vectors.shape
    if not n or not len(best.vectors):
        return
    if not dims:
        for q in range(len(best.vectors)):
            best.add(q, np.zeros(n, np.int64), ids)
        return
    lists = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
    values = np.take_along_axis(vectors, lists, axis=0)
    # Sums of products are exact in doubles under 2^53, in 64-bit integers under 2^63, and in Python's beyond.
    most = max(abs(int(vectors.min())), abs(int(vectors.max()))) * max(abs(int(best.vectors.min())), abs(int(best.vectors.max()))) * dims
    kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object
    rows, asked, bounds = vectors.astype(kind), best.vectors.astype(kind), values.astype(kind)
    out = object if kind is object else np.int64
    for q in range(len(best.vectors)):
        weight = best.vectors[q]
        live = np.flatnonzero(weight)
        seen = np.zeros(n, bool)
        depth, step = 0, 16
        up = weight[live] > 0
        while depth < n:
            # Nothing unseen can score above the bound of the lists' current values.
            edge = np.where(up, n - 1 - depth, depth)
            bound = int((asked[q, live] * bounds[edge, live]).sum()) if len(live) else 0
            low = best.kth(q)
            if low is not None and bound < low:
                break
            to = min(n, depth + step) if len(live) else n
            if len(live):
                met = np.concatenate([lists[n - to : n - depth, live[up]].ravel(), lists[depth:to, live[~up]].ravel()])
            else:
                met = np.arange(n)
            mask = np.zeros(n, bool)
            mask[met] = True
            mask &= ~seen
            fresh = np.flatnonzero(mask)
            seen |= mask
            if len(fresh):
                best.add(q, (rows[fresh] @ asked[q]).astype(out), ids[fresh])
            depth, step = to, step * 4
            if len(live) and seen.all():
                break


def _searcher(queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int, shard_rows: int):
    """queries: by vector length, (numbers, vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bests = {d: Best(vectors, k) for d, (_, vectors) in queries.items()}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            lists = batch.column(1)
            flat = lists.flatten().to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            at = np.concatenate([[0], np.cumsum(sizes)])
            for d, best in bests.items():
                pick = np.flatnonzero(sizes == d)
                for i in range(0, len(pick), shard_rows):
                    part = pick[i : i + shard_rows]
                    search_shard(best, ids[part], flat[at[part][:, None] + np.arange(d)])
        for d, best in bests.items():
            q = np.repeat(np.arange(len(best.vectors)), best.filled)
            r = np.concatenate([np.arange(n) for n in best.filled]) if len(q) else q
            yield pa.RecordBatch.from_arrays([pa.array(queries[d][0][q], pa.int64()), pa.array(best.found[q, r]), pa.array(best.scores[q, r])], names=["q", "vec_id", "score"])

    return run


RESULT = "query_id bigint, rank int, vec_id bigint, score bigint"


def _answers(asked: list, rows: DataFrame, k: int, shard_rows: int) -> DataFrame:
    """The results of one block of distinct queries (vec_id, v, n: rows that ask so)."""
    by_length: dict[int, list] = {}
    for number, r in enumerate(asked):
        by_length.setdefault(len(r["v"]), []).append((number, r["v"]))
    packed = {d: (np.array([n for n, _ in rs], np.int64), np.array([v for _, v in rs], np.int64).reshape(len(rs), d)) for d, rs in by_length.items()}
    found = rows.select("vec_id", "v").mapInArrow(_searcher(packed, k + 1, shard_rows), "q bigint, vec_id bigint, score bigint")
    by_rank = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    ranked = found.select("q", "vec_id", "score", F.row_number().over(by_rank).alias("at")).filter(F.col("at") <= k + 1)
    # At most QUERY_ROWS rows of four numbers. A self-score beyond 64 bits has raised before, or ranks below all.
    own = [(n, r["vec_id"], s if (s := sum(x * x for x in r["v"])) < 1 << 63 else None, r["n"]) for n, r in enumerate(asked)]
    named = rows.sparkSession.createDataFrame(own, "q long, query_id long, own long, n long")
    mine = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("at"))).over(Window.partitionBy("q"))
    told = ranked.join(F.broadcast(named), "q").withColumn("mine", F.coalesce(mine, F.lit(k + 1))).filter(F.col("at") != F.col("mine"))
    rank = (F.col("at") - F.when(F.col("at") > F.col("mine"), 1).otherwise(0)).cast("int")
    return told.select("query_id", rank.alias("rank"), "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("col")


def search(queries: DataFrame, rows: DataFrame, k: int = K, query_rows: int = QUERY_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: both inputs hold vec_id and v (see `integers`); each query is a row of `rows` too."""
    spark = rows.sparkSession
    distinct = queries.groupBy("vec_id", "v").agg(F.count("*").alias("n"))
    blocks = max(1, math.ceil(distinct.count() / query_rows))
    scratch, parts = Scratch(spark), []
    for b in range(blocks):
        block = distinct if blocks == 1 else distinct.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b)
        if asked := block.orderBy("vec_id", "v").collect():
            found = _answers(asked, rows, k, shard_rows)
            parts.append(found if blocks == 1 else scratch.cut(found))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], RESULT)


ORACLE_SQL = """
WITH vecs AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
              WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM vecs q JOIN vecs c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
