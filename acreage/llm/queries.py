"""Registered queries of the package and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acreage.llm import class_model, fingerprints, languages, licences, merkle, mixing, near_dedup, packing, quality, suffix_dedup, token_counts, twins, url_filter, vector_codes
from acreage.session import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, url_filter.listed(spark)).select("page_id", "host", "path", "rule", "verdict")


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(_table(spark, sf_dir, "documents"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    crc = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset", "window", "step_group")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify(_table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    rows = cut(docs)  # the texts are counted once
    mixed = mixing.mix_sources(rows, ["doc_id"], size=F.col("size"))
    return mixed.select("doc_id", *[F.col(f"mix.{c}").alias(c) for c in ("size", "source_size", "target", "taken")])


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op11_class_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_model.score_texts(_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


_ALL = [
    op1_minhash_near_dedup, op2_url_filter, op3_licence_scan, op4_token_counts, op5_quality_rules, op6_packing, op7_language_id, op8_source_mixing, op9_fingerprints,
    op10_suffix_dedup, op11_class_model, op12_vector_codes, op13_merkle_manifest,
]
QUERIES = {f.__name__: f for f in _ALL}
ORACLE: dict[str, str] = {
    "op1_minhash_near_dedup": twins.NEAR_DUPLICATES, "op2_url_filter": url_filter.oracle(), "op8_source_mixing": mixing.ORACLE, "op10_suffix_dedup": twins.REPEATS, "op12_vector_codes": vector_codes.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
