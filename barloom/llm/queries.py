"""The registered queries of the corpus operators."""

from __future__ import annotations

import public_tokenizers as P
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bitpack, bpe, decontaminate, imatch, langid, licenses, sharding, simhash, substring, suffixes, token_counts, trie
from .common import shared_dir, table


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("places")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40)


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_xxhash64")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_edits(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/ids"
    bitpack.write_ids(table(spark, sf_dir, "documents"), out, P.path("byte_bpe_50k.json"), vocabulary=50257)
    return bitpack.read_documents(spark, out)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"))


def op11_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.repeats(table(spark, sf_dir, "documents"), length=50)
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_statistics(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_bpe": op2_bpe,
    "op3_language": op3_language,
    "op4_sharding": op4_sharding,
    "op5_passages": op5_passages,
    "op6_simhash": op6_simhash,
    "op7_decontamination": op7_decontamination,
    "op8_fingerprints": op8_fingerprints,
    "op9_token_files": op9_token_files,
    "op10_token_counts": op10_token_counts,
    "op11_suffixes": op11_suffixes,
    "op12_trie": op12_trie,
    "op13_alignment": op13_alignment,
}
ORACLE_SQL: dict[str, str] = {"op1_licenses": licenses.oracle(), "op7_decontamination": decontaminate.oracle(), "op11_suffixes": suffixes.oracle(), "op12_trie": trie.oracle()}
