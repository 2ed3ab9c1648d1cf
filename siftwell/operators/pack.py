"""Blocks to chunks of bounded size, in order; and how chunks are written out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import n_tokens

#: Share of the budget that blocks may fill, tokens of a block's heading, least number of characters.
FILL, HEADING, LEAST_CHARS = 0.85, 60, 30_000


def pack(blocks: DataFrame, max_blocks: int, budget: int) -> DataFrame:
    """Blocks (report_id, block_id, text) to (report_id, chunk, block_ids, tokens, oversized).

    A chunk is closed when the next block would exceed the number of blocks, the tokens or the characters; no block is cut.
    Whether it does depends on what is open, so this is a fold over a report's blocks, not a window. Only ids and sizes
    are gathered, not texts. oversized: the chunk was empty when a block above the budget came.
    """
    cap, chars = int(budget * FILL), max(LEAST_CHARS, 2 * budget)
    sized = blocks.select("report_id", F.struct("block_id", (n_tokens(F.col("text")) + HEADING).alias("tokens"), F.length("text").alias("chars")).alias("b"))
    chunk = "struct<block_ids:array<int>,tokens:int,chars:int,oversized:boolean>"
    empty = F.struct(F.array().cast("array<int>").alias("block_ids"), F.lit(0).alias("tokens"), F.lit(0).alias("chars"), F.lit(False).alias("oversized"))

    def step(acc: Column, b: Column) -> Column:
        open_ = acc["open"]
        n = F.size(open_["block_ids"])
        close = (n > 0) & ((n >= max_blocks) | (open_["tokens"] + b["tokens"] > cap) | (open_["chars"] + b["chars"] > chars))
        alone = F.struct(F.array(b["block_id"]).alias("block_ids"), b["tokens"].alias("tokens"), b["chars"].alias("chars"), ((n == 0) & (b["tokens"] > cap)).alias("oversized"))
        more = F.struct(F.concat(open_["block_ids"], F.array(b["block_id"])).alias("block_ids"), (open_["tokens"] + b["tokens"]).alias("tokens"), (open_["chars"] + b["chars"]).alias("chars"), open_["oversized"].alias("oversized"))
        done = F.when(close, F.concat(acc["done"], F.array(open_))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(close | (n == 0), alone).otherwise(more).alias("open"))

    start = F.struct(F.array().cast(f"array<{chunk}>").alias("done"), empty.alias("open"))
    folded = F.aggregate(F.array_sort(F.collect_list("b")), start, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))
    out = sized.groupBy("report_id").agg(folded.alias("chunks")).select("report_id", F.posexplode("chunks").alias("chunk", "c"))
    return out.select("report_id", "chunk", "c.block_ids", "c.tokens", "c.oversized")


def retry_limit(max_blocks: int, attempt: int) -> int:
    """Blocks of a chunk shrink with each attempt."""
    return max(1, max_blocks // 2**attempt)


def rendered(host: Column, port: Column, protocol: Column, block_id: Column, text: Column) -> Column:
    """A block with its heading; the port only if both it and the protocol are known."""
    about = F.concat_ws(", ", F.concat(F.lit("host: "), host), F.when(port.isNotNull() & protocol.isNotNull(), F.concat(F.lit("port: "), port, F.lit("/"), protocol)))
    return F.concat(F.lit("### BLOCK "), block_id.cast("string"), F.when(about != "", F.concat(F.lit(" ("), about, F.lit(")"))).otherwise(""), F.lit("\n"), text)


def chunk_texts(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """report_id, chunk and the text of its blocks, in order."""
    members = chunks.select("report_id", "chunk", F.explode("block_ids").alias("block_id")).join(blocks, ["report_id", "block_id"])
    part = F.struct("block_id", rendered(*[F.col(c) for c in ("host", "port", "protocol", "block_id", "text")]).alias("text"))
    return members.groupBy("report_id", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), "\n\n").alias("text"))


def truncated(text: Column, budget: int) -> Column:
    """A text above the budget, cut behind its last whole line, with a note."""
    cut = F.substring(text, 1, int(budget * 3.5))
    whole = F.nullif(F.regexp_extract(cut, r"(?s)^(.*)\n[^\n]*$", 1), F.lit(""))
    return F.when(n_tokens(text) > budget, F.concat(F.coalesce(whole, cut), F.lit("\n[TRUNCATED: the rest of this block exceeds the input budget]"))).otherwise(text)
