"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import curriculum, decontam, htmltext, katz, langid, passages, secrets, simhash, topk, toxicity
from .common import spread, table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return langid.predict(docs, langid.fit(docs))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(spark, spread(table(spark, sf_dir, "documents")))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(spread(table(spark, sf_dir, "documents")))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.integers(spread(table(spark, sf_dir, "embeddings")))
    return topk.search(rows.filter("vec_id % 50 = 0"), rows)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(spark, spread(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(spark, spread(table(spark, sf_dir, "pages")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.classes(spark, spread(table(spark, sf_dir, "documents")))


def op10_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum.mix(spark, table(spark, sf_dir, "documents"))
    last = F.try_element_at("positions", F.lit(-1)).alias("last_position")
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken", F.size("positions").cast("long").alias("passes"), "position", last)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language": op1_language,
        "op2_decontaminate": op2_decontaminate,
        "op3_katz": op3_katz,
        "op4_secrets": op4_secrets,
        "op5_topk": op5_topk,
        "op6_simhash": op6_simhash,
        "op7_extract": op7_extract,
        "op8_toxicity": op8_toxicity,
        "op9_passages": op9_passages,
        "op10_curriculum": op10_curriculum,
        "pipeline": pipeline,
    }


_WORDS = r"regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATE_SQL = rf"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM (SELECT item_id, {_LOWER} AS lower_ascii FROM benchmark)),
sized AS (SELECT item, w, least(10, len(w)) AS k FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
            FROM (SELECT item, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM sized)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM (SELECT doc_id, {_LOWER} AS lower_ascii FROM documents)),
lengths AS (SELECT DISTINCT k FROM windows),
grams AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
          FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM docs, lengths WHERE len(w) >= k)),
hits AS (SELECT doc_id, k, i, item FROM grams JOIN windows USING (k, win)),
marked AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + k - 1)) AS at FROM hits),
counts AS (SELECT doc_id, count(*) AS n_hit FROM marked GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN counts USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": DECONTAMINATE_SQL, "op5_topk": topk.ORACLE_SQL, "op10_curriculum": curriculum.ORACLE_SQL}
