"""A corpus pipeline: language ID, SimHash near-dedup, substring dedup, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.
"""

from __future__ import annotations

import public_tokenizers as P
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, decontaminate, langid, simhash, substring
from barloom.llm.common import only, shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets lang to the predicted language; documents without a language (no text or no letter) go."""
    model = langid.train(docs)
    told = langid.predict(docs, model, keep=("text", "source", "n_chars"))
    return told.where("lang_pred <> 'und'").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest id, of each group of texts linked at a similarity of 0.8 (5-word shingles)."""
    gone = simhash.similar_texts(docs).where("doc_id <> component_id").select("doc_id")
    return only(docs, gone, "left_anti", on="doc_id").select("doc_id", "text", "lang", "source", "n_chars")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of at least 50 words out of every document but the first that has them."""
    out = substring.cut(docs, substring.passages(docs))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the benchmark contaminates."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    told = decontaminate.decontaminate(docs, items).where("contaminated")
    # A row is named by its id, if it has one, and its text's hash.
    bad = told.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_k"), F.col("text_xxhash64").alias("_t")).distinct()
    named = docs.withColumns({"_k": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "_t": F.xxhash64(F.coalesce("text", F.lit("")))})
    return only(named, bad, "left_anti", on=["_k", "_t"]).select("doc_id", "text", "lang", "source", "n_chars")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes each text and proves by decoding that nothing is lost."""
    return bpe.round_trip(docs, P.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("bpe", tokens),
]
#: XXH64, min-hashes and merges are out of reach of SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
