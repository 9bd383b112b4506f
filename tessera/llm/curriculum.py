"""Mixing sources to target weights with a time-varying curriculum. DataFrame functions only.

Each source has a weight schedule over training time t in [0, 1]: its share of
the mix times 1 + a(1 - 2t), where a > 0 puts it early and a < 0 late. The
schedule integrates to the share, so the cumulative token demand of a source is
target * (t + a(t - t^2)). A source's documents stand in the order of their
hash; the k-th token it supplies is wanted when the demand reaches k, and
inverting the demand gives each document its training position, one for every
pass that takes words of it. Documents, with their texts and all other columns,
are then range-sorted by the first position.

Shares: sources in code-point order (null last) weigh `weights`, repeating, and
share all tokens; a target stops at `most` times its source's size and the rest
is shared again by weight (solved exactly as a water level). A source supplies
whole passes over its documents and then the first words of one more pass, so
its taken words equal its rounded target, and no document exceeds `most` passes.

Running totals inside a source go by hash bucket: sums per bucket, then totals
inside a bucket, so a source with a third of all rows spreads over thousands of
groups. The hash is of the id and the text, so rows that share an id, or have
none, spread as well; rows without words supply nothing and spread by number.
Only per-source sums are ever ordered in one task. Texts wait in the shared
folder meanwhile and join their places by row number. As training time is spent
evenly, a part of the sorted output is a stretch of it, and no sampling pass is
needed to place the rows.

Defined cases: null, empty and word-less texts have size 0 and take nothing;
null sources form one source; null doc_ids order as the word null; rows equal in
id and text follow each other by a hash of their other columns, and rows equal
in all are told apart arbitrarily, which leaves the returned rows the same; an empty table returns no row; zero total
gives targets of zero; an input column named like a result column gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

WEIGHTS = (1, 2, 3)
#: Emphasis by weight class: the lightest sources lean early, the heaviest late.
SLOPES = (0.5, 0.0, -0.5)
MOST = 3
#: Hash buckets of a source; three hex digits of the key.
BUCKET_DIGITS = 3
#: Bytes of text aimed at per part of the sorted output.
PART_BYTES = 64 << 20


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _cycle(rank: Column, values: tuple) -> Column:
    out = F.lit(values[0])
    for i, v in enumerate(values):
        out = F.when(F.pmod(rank, F.lit(len(values))) == i, F.lit(v)).otherwise(out)
    return out


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, most: int = MOST) -> DataFrame:
    """source, source_size, target, slope of every source of (source, size) rows."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sums.select("source", "source_size", (F.row_number().over(named) - 1).alias("rank")).select("*", _cycle(F.col("rank"), weights).cast("double").alias("w"), _cycle(F.col("rank"), slopes).cast("double").alias("slope"))
    # Water level: by source_size * most / w, a source is capped while its ratio stays under the level of what is left.
    order = Window.orderBy((F.col("source_size") * most / F.col("w")).asc(), F.col("rank").asc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = ranked.select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        F.sum("w").over(every).alias("all_w"),
        F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0)).alias("before_size"),
        F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("before_w"),
    )
    capped = (F.col("source_size") * most / F.col("w")) <= (F.col("total") - F.col("before_size")) / (F.col("all_w") - F.col("before_w"))
    marked = seen.select("*", capped.alias("capped"))
    level = F.try_divide(
        F.col("total") - F.sum(F.when(F.col("capped"), F.col("source_size") * most).otherwise(0)).over(every),
        F.col("all_w") - F.sum(F.when(F.col("capped"), F.col("w")).otherwise(0.0)).over(every),
    )
    return marked.select("source", "source_size", F.when(F.col("capped"), (F.col("source_size") * most).cast("double")).otherwise(F.col("w") * level).alias("target"), "slope")


def position(demand: Column, target: Column, slope: Column) -> Column:
    """The time t at which target * (t + slope * (t - t^2)) reaches the demand."""
    x = F.least(F.try_divide(demand.cast("double"), target), F.lit(1.0))
    b = slope + 1.0
    return 2.0 * x / (b + F.sqrt(F.greatest(b * b - 4.0 * slope * x, F.lit(0.0))))


def mix(spark: SparkSession, docs: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, position, positions and the other columns of docs: the documents range-sorted by first training position.

    positions has the position of each pass that takes words of the document, in
    order; position is the first of them, null for documents the mix takes nothing of.
    """
    scratch = Scratch(spark)
    text, row = F.col("text").cast("string"), F.monotonically_increasing_id()
    size = word_count(text)
    of_row = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.when(size > 0, F.md5(text.cast("binary"))).otherwise(row.cast("string")))
    key = F.md5(of_row.cast("binary"))
    made = ("doc_id", "source", "size", "source_size", "target", "taken", "position", "positions")
    others = {f"c{i}": c for i, c in enumerate(docs.columns) if c not in made}
    whole = F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(k) for k, c in others.items() if c != "text"))
    tie = F.xxhash64(F.to_json(whole) if "map<" in docs.schema.simpleString() else whole)
    # Row numbers hold, as they are written with the rows.
    held = scratch.cut(
        docs.select(
            *(F.col(f"`{c}`").alias(k) for k, c in others.items()),
            "doc_id",
            F.col("source").cast("string").alias("source"),
            size.alias("size"),
            F.octet_length(text).alias("bytes"),
            key.alias("key"),
            F.substring(key, 1, BUCKET_DIGITS).alias("bucket"),
            row.alias("row"),
            tie.alias("tie"),
        )
    )
    sized = held.drop(*others)
    targets = source_targets(sized, weights, slopes, most)
    by_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    starts = buckets.select("source", "bucket", F.coalesce(F.sum("n").over(by_source), F.lit(0)).alias("start"))
    # Source facts ride on the bucket rows, so documents meet both in one join whose key is split by bucket.
    facts = starts.join(targets, starts["source"].eqNullSafe(targets["source"])).select(starts["source"].alias("s"), starts["bucket"].alias("b"), "start", "source_size", "target", "slope")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    ordered = sized.select("*", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("offset"))
    placed = ordered.join(facts, ordered["source"].eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).select("row", "doc_id", "source", "key", "size", "source_size", "target", "slope", (F.col("start") + F.col("offset")).alias("before"))
    budget = F.floor(F.col("target") + 0.5)
    whole = F.coalesce(F.floor(F.try_divide(budget, F.col("source_size"))), F.lit(0)).cast("long")
    rest = F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("whole") * F.col("source_size") - F.col("before"))).cast("long")
    out = placed.withColumn("whole", whole).withColumn("rest", rest).withColumn("taken", F.col("size") * F.col("whole") + F.col("rest"))
    passes = F.col("whole") + F.when(F.col("rest") > 0, 1).otherwise(0)
    at = F.transform(F.sequence(F.lit(0).cast("long"), passes - 1), lambda n: position(F.col("before") + n * F.col("source_size"), F.col("target"), F.col("slope")))
    out = out.withColumn("positions", F.when(F.col("taken") > 0, at).otherwise(F.array().cast("array<double>")))
    out = out.withColumn("position", F.when(F.col("taken") > 0, position(F.col("before"), F.col("target"), F.col("slope"))))
    # Documents not taken follow after the end, spread by their hash.
    place = F.coalesce(F.col("position"), 1.0 + F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 2.0**32)
    out = out.withColumn("place", place)
    if others:
        out = out.join(held.select("row", *others), "row")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(held.agg(F.sum("bytes")).first()[0] or 0) // PART_BYTES))
    out = out.repartitionById(2 * parts, F.least(F.floor(F.col("place") * parts), F.lit(2 * parts - 1)).cast("int"))
    return out.sortWithinPartitions("place", "key").select(*made, *(F.col(k).alias(c) for k, c in others.items()))


ORACLE_SQL = r"""
WITH counted AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sized AS (SELECT doc_id, source, size, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), '')) AS key FROM counted),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, CAST((row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w,
         [0.5, 0.0, -0.5][CAST((row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS slope,
         row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) AS rank FROM sums),
seen AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(w) OVER () AS all_w,
         coalesce(CAST(sum(source_size * 3) OVER (ORDER BY source_size * 3 / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0) AS before_size,
         coalesce(sum(w) OVER (ORDER BY source_size * 3 / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_w FROM ranked),
marked AS (SELECT *, source_size * 3 / w <= (total - before_size) / (all_w - before_w) AS capped FROM seen),
targets AS (SELECT source, source_size, CAST(slope AS DOUBLE) AS slope, CASE WHEN capped THEN CAST(source_size * 3 AS DOUBLE) ELSE
         w * ((total - CAST(sum(CASE WHEN capped THEN source_size * 3 ELSE 0 END) OVER () AS DOUBLE)) / (all_w - sum(CASE WHEN capped THEN w ELSE 0 END) OVER ())) END AS target FROM marked),
placed AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.slope, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
         coalesce(CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before
         FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
passed AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size END AS whole FROM placed),
given AS (SELECT *, greatest(0, least(size, budget - whole * source_size - before)) AS rest FROM passed),
mixed AS (SELECT *, CAST(size * whole + rest AS BIGINT) AS taken, CASE WHEN size * whole + rest > 0 THEN CAST(whole + CASE WHEN rest > 0 THEN 1 ELSE 0 END AS BIGINT) ELSE 0 END AS passes FROM given),
wanted AS (SELECT *, least(CAST(before AS DOUBLE) / target, 1.0) AS x, least(CAST(before + (passes - 1) * source_size AS DOUBLE) / target, 1.0) AS y, slope + 1.0 AS b FROM mixed)
SELECT doc_id, source, size, source_size, target, taken, passes,
       CASE WHEN taken > 0 THEN CAST(2.0 AS DOUBLE) * x / (b + sqrt(greatest(b * b - CAST(4.0 AS DOUBLE) * slope * x, 0.0))) END AS position,
       CASE WHEN taken > 0 THEN CAST(2.0 AS DOUBLE) * y / (b + sqrt(greatest(b * b - CAST(4.0 AS DOUBLE) * slope * y, 0.0))) END AS last_position
FROM wanted
"""
