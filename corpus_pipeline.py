"""The corpus pipeline: documents pass the stages in order, each written and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vigil.llm.exact_dedup import exact_dedup
from vigil.llm.mixing import poisson_mix
from vigil.llm.packing import pack
from vigil.llm.quality import fit_quality, score_quality
from vigil.llm.simhash import simhash_dedup
from vigil.sources.store import materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels that aren't held out, accepts (equal texts alike)."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).filter("predicted = 1").select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts those with the largest doc_id (a null one is below all others)."""
    return exact_dedup(docs).filter("kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are linked those with the smallest doc_id; texts without words link with each other."""
    return simhash_dedup(docs, words=4, radius=4).filter("kept").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal expected shares of all sources, a null source included, as many rows as came in; a row per copy."""
    return poisson_mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents (a copy is a document of its own) and their places in sequences."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return pack(docs, vocabulary, with_ids=False, carry=["doc_id"]).drop("ids")


STAGES = [
    ("quality_classifier", keep_good),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("poisson_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

# Compression, fingerprints and tokens are outside SQL; tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
