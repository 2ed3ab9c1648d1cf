"""Queries of the operators of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwell.plans.staging import table


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.pii import digests

    return digests(table(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.sp_codec import digests

    return digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.secret_scan import digests

    return digests(table(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.token_output import token_files

    return token_files(spark, table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.toxicity import predictions

    return predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_token_counts": op1,
    "op2_pii": op2,
    "op3_mixing": op3,
    "op4_sentencepiece": op4,
    "op5_secret_scan": op5,
    "op6_token_output": op6,
    "op7_minhash_dedup": op7,
    "op8_neighbours": op8,
    "op9_toxicity": op9,
    "op10_fingerprints": op10,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {}
