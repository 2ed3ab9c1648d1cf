"""An extractor's answers bound back to the blocks that they are about, with retries for what is missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.functions.text import unfenced
from siftwell.operators.pack import chunk_texts, pack, retry_limit
from siftwell.plans.staging import stage

ATTEMPTS = 3


def enveloped(answer: Column) -> Column:
    """A bare list or a bare object brought to {"items": [...]}."""
    text = unfenced(answer)
    return F.when(F.startswith(text, F.lit("[")), F.concat(F.lit('{"items":'), text, F.lit("}"))).when(
        F.startswith(text, F.lit("{")) & ~F.array_contains(F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")), "items"), F.concat(F.lit('{"items":['), text, F.lit("]}"))).otherwise(text)


def parsed(answers: DataFrame, item: str, allowed: list[str]) -> DataFrame:
    """answers (report_id, chunk, raw) to items (report_id, chunk, pos, block_id, item) and a flag of chunks that are valid.

    A chunk with broken JSON, an item without block id or with a key that isn't allowed is invalid as a whole.
    """
    rows = answers.withColumn("json", enveloped(F.col("raw"))).withColumn("texts", F.from_json("json", "items array<string>")["items"])
    ok = F.col("texts").isNotNull() & F.forall("texts", lambda t: F.get_json_object(t, "$.block_id").isNotNull() & (F.size(F.array_except(F.json_object_keys(t), F.array(*[F.lit(a) for a in allowed]))) == 0))
    rows = rows.withColumn("valid", F.coalesce(ok, F.lit(False)))
    return rows.select("report_id", "chunk", "valid", F.posexplode_outer(F.when(F.col("valid"), F.col("texts"))).alias("pos", "text")).select("report_id", "chunk", "valid", "pos", F.get_json_object("text", "$.block_id").try_cast("int").alias("block_id"), F.from_json("text", item).alias("item"))


def reconciled(members: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bound, dropped, missing) of chunk members (report_id, chunk, block_id) and items (report_id, chunk, pos, block_id, ...).

    The first item for a member binds; items for no member are unknown, later ones duplicates; members without are missing.
    """
    key = ["report_id", "chunk", "block_id"]
    given = items.where(F.col("block_id").isNotNull())
    unknown = given.join(members, key, "left_anti").withColumn("reason", F.lit("unknown"))
    known = given.join(members, key, "left_semi").withColumn("turn", F.row_number().over(W.partitionBy(*key).orderBy("pos")))
    bound = known.where("turn = 1").drop("turn")
    again = known.where("turn > 1").drop("turn").withColumn("reason", F.lit("duplicate"))
    return bound, unknown.unionByName(again), members.join(bound, key, "left_anti")


def backfilled(bound: DataFrame, blocks: DataFrame, source: str) -> DataFrame:
    """Host and source set from the block; port where the record has none, then the protocol too if it is tcp or udp."""
    b = blocks.select("report_id", "block_id", F.col("host").alias("block_host"), F.col("port").alias("block_port"), F.col("protocol").alias("block_protocol"))
    lacks = F.col("port").isNull() & F.col("block_port").isNotNull()
    real = F.col("block_protocol").isin("tcp", "udp")
    rows = bound.join(b, ["report_id", "block_id"])
    return rows.select(*[c for c in bound.columns if c not in ("host", "port", "protocol", "source")], F.col("block_host").alias("host"), F.coalesce("port", "block_port").alias("port"), F.when(lacks & real, F.col("block_protocol")).otherwise(F.col("protocol")).alias("protocol"), F.lit(source).alias("source"))


def extract(blocks: DataFrame, extractor: Callable[[DataFrame], DataFrame], item: str, allowed: list[str], max_blocks: int, budget: int) -> tuple[DataFrame, DataFrame]:
    """(items bound to blocks, blocks that no attempt answered).

    extractor: chunks (report_id, chunk, text) to answers (report_id, chunk, raw). Chunks get smaller with each attempt; what is
    bound is written, so an attempt is never asked twice.
    """
    pending, out = blocks, None
    for attempt in range(ATTEMPTS):
        chunks = stage(pack(pending, retry_limit(max_blocks, attempt), budget), "chunks")
        members = chunks.select("report_id", "chunk", F.explode("block_ids").alias("block_id"))
        answers = stage(extractor(chunk_texts(chunks, pending)), "answers")
        bound, _, missing = reconciled(members, parsed(answers, item, allowed))
        bound = stage(bound.select("report_id", "block_id", "item"), "bound")
        out = bound if out is None else out.unionByName(bound)
        pending = stage(pending.join(missing, ["report_id", "block_id"], "left_semi"), "pending")
        if pending.isEmpty():
            break
    return out, pending


def cost(usage: DataFrame, profiles: DataFrame) -> DataFrame:
    """usage (model, prompt_tokens, completion_tokens) and profiles (model, price_in, price_out a million) to calls, sums and cost."""
    total = usage.groupBy("model").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    return total.join(F.broadcast(profiles), "model", "left").withColumn("cost", F.col("prompt_tokens") / 1e6 * F.coalesce("price_in", F.lit(0.0)) + F.col("completion_tokens") / 1e6 * F.coalesce("price_out", F.lit(0.0)))


def answer_limit(most: Column, context: Column, prompt: Column) -> Column:
    """Tokens that an answer may take: what the context leaves beside the prompt (a third of its characters) and a reserve."""
    return F.greatest(F.lit(256), F.least(most, context - F.floor(F.length(prompt) / 3) - 128)).cast("int")


def in_block_order(records: DataFrame) -> DataFrame:
    """Bound records in the order of their blocks within a report; a sort within partitions of whole reports."""
    return records.repartition("report_id").sortWithinPartitions("report_id", "block_id")
