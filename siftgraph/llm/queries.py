"""The registered query of each operator, with production parameters, and its SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, infill, licenses, lm, shards, spelling


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scanned

    return scanned(_read(spark, sf_dir, "documents"))


def license_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op1_licenses``' operator over licence files as they occur, which the documents don't hold."""
    return licenses.scanned(spark.createDataFrame(licenses.variants(), "doc_id int, text string"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import classes

    return classes(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_runs", "keep")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import parsed_pieces, train, transcripts

    talks = _read(spark, sf_dir, "conversations")
    return parsed_pieces(transcripts(talks), train(talks))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import neighbours

    return neighbours(_read(spark, sf_dir, "embeddings"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import scores

    return scores(_read(spark, sf_dir, "documents"))


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op5_lm_scores`` that SQL can give."""
    rows = op5_lm_scores(spark, sf_dir)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shards import sharded

    return sharded(_read(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judged

    return judged(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, found, train

    docs = _read(spark, sf_dir, "documents")
    rows = found(docs, train(docs))
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination, digest

    return digest(contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")))


def op10_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    from .bpe import digests

    path = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(_read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(_read(spark, sf_dir, "documents"), slip=97)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(_read(spark, sf_dir, "documents"))


def op13_prefix_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    from .prefix_bpe import digests

    return digests(_read(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_licenses, license_variants, op2_near_duplicates, op3_chat, op4_neighbours, op5_lm_scores, lm_base_scores, op6_sharding, op7_quality, op8_pii, op9_decontamination, op10_byte_bpe, op11_spelling, op12_fill_in_middle, op13_prefix_bpe)}
ORACLE_SQL = {"op1_licenses": licenses.oracle_sql(), "license_variants": licenses.variants_sql(), "lm_base_scores": lm.base_sql(), "op6_sharding": shards.oracle_sql(), "op9_decontamination": decontaminate.oracle_sql(), "op11_spelling": spelling.oracle_sql(), "op12_fill_in_middle": infill.oracle_sql()}
