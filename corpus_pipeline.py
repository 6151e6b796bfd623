"""Corpus preparation: language ID, quality rules, near-duplicate removal, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns what the next one works on; ``run`` writes
each stage's rows as Parquet in the shared folder and reads them again. Null and empty texts go with
the first stage (no language), as do columns beyond those of documents; null ids stay, rows equal
in id and text become one in the third. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.llm import langid, neardup, packing, pii, quality
from palimpsest.llm.queries import BYTE_BPE
from palimpsest.runtime import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near-duplicate parameters of the pipeline: words of a shingle, least similarity in percent.
SHINGLE, SIMILARITY = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without an identifiable language (null text, or no letter); ``lang`` is the predicted one from here on.

    Without any labelled document nothing can be told apart: then all documents with a letter stay, their ``lang`` as it is.
    """
    model = langid.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = langid.identify(docs, model, keep=COLUMNS)
    return found.where("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def apply_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the rules or the trees reject."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.quality_rules(docs, model, keep=COLUMNS).where("kept").select(*COLUMNS)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies."""
    return neardup.keep_one(docs, shingle=SHINGLE, similarity=SIMILARITY).select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace each personal span by its kind in brackets."""
    return pii.redact(docs, pii.default_model()).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 1024 tokens."""
    return packing.harmonic_pack(docs, BYTE_BPE)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality),
    ("near_dedup", remove_near_copies),
    ("pii", redact),
    ("packing", pack),
]

#: Trained models decide which rows stay, which SQL does not express; tests hold each stage against a plain computation of its rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all of ``documents``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
