"""Documents to token ids: toxic ones go, one of each group of near-duplicates stays, personal data is masked, sources
are mixed to their targets, and what the mix takes is encoded.

Each stage is a function of (spark, docs, sf_dir); run() writes each stage's rows and reads them back for the next.

Defined results, for every stage: an empty table gives an empty one; columns beyond those of documents may have any names and
are kept as they are (the last stage names its columns). A null text counts as an empty one and stays null. A null doc_id is
never a duplicate of another row. Rows that repeat are each decided alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.mixing import mixed
from siftwell.llm.near_dup import deduplicated
from siftwell.llm.pii import redacted
from siftwell.llm.queries import tokenizer
from siftwell.llm.sp_codec import encode_documents
from siftwell.llm.toxicity import score, train
from siftwell.plans.staging import stage, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model trained on the labels scores below 0.5; without labels every score is 0.5 and all stay.

    Null and empty texts have the score of no words; they go only if most labelled documents are toxic.
    """
    labels = table(spark, sf_dir, "labels")
    if not labels.where("toxic IS NOT NULL").limit(1).count():
        return docs
    into = "toxicity_score"
    while into in docs.columns:
        into += "_"
    return score(docs, train(docs, labels), into=into).where(F.col(into) < 0.5).drop(into)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, that with the least doc_id; rows that repeat it stay, as do texts
    without words and rows without a doc_id."""
    return deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of personal data replaced by its kind; n_chars is that of the new text, null for none."""
    out = redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without words aren't taken, null is a source of its own."""
    return mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source of each document with its ids, their number and the text decoded from them; a null or empty text
    has the end id alone."""
    rows = encode_documents(docs.select("doc_id", "lang", "source", "text"), tokenizer("piece_bpe_32k.model"))
    return rows.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "decoded")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("encoding", encoding)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
