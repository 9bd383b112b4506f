"""A training-data pipeline over the documents table: filter, dedup, clean, mix.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept;
all return the columns of documents, the last with the training positions too.

Defined cases, the same for all stages: an empty table gives an empty one; null
and empty texts are kept unless they are copies of each other; null ids, sources
and other columns pass on; texts of any length are read whole; repeated rows are
copies; extra columns, whatever their names, pass on (a column named like one of
the mix gives way to it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import curriculum, decontam, secrets, simhash, toxicity
from tessera.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labels of the stage's documents.

    Without labels of both kinds nothing scores over the threshold but by the labels' own share.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the smallest id; word-less texts are one component."""
    return simhash.keep_one(spark, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; an empty benchmark removes none."""
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts, n_chars follows; every document stays."""
    out = secrets.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their training positions and words taken, range-sorted by first position."""
    return curriculum.mix(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("mixing", mix_sources),
]

#: Training, fingerprints and decoders have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            before, out = docs, scratch.cut(out)
            scratch.drop(before)  # the stage's input, once its output is written
        docs = out
    return docs
