"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

Every document of a source is to be taken target / source_size times on average. The whole part of that is certain
copies. The rest of the target's words comes from a sample of fixed size with unequal inclusion probabilities: a document
is taken once more with a probability in proportion to size ** -TILT, at most 1, so that a long text is repeated less
often than a short one, and so that the expected words are the words that are still needed.

Documents of a source fall into tiers of like size, `STEPS` for each doubling. The number that a tier gives is fixed before
anything is drawn: tiers take their expected words from the largest size down, and what rounding to whole documents leaves
goes to the next tier. Within a tier documents are ranked by their random odds over their inclusion odds,
(u / (1 - u)) / (p / (1 - p)) with u from the id, and the first n are taken. So the words of a source come near its target
within about a small document and the spread of sizes within tiers.

Ranks are not sorted a source at a time: they fall into bins of about `FULL` documents, bins are counted, and only the bin
in which a tier's number runs out is looked at row by row.

Defined results: a null text has size 0; a document of size 0 is taken 0 words. Null is a source of its own. Rows that
repeat a doc_id share its random number; rows that are equal in id, source and text share their fate, and such a group at the
cut is taken whole. Without any words all targets are 0. An empty table gives an empty one. Further columns may have any
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.plans.staging import drop, stage

#: Tiers a doubling of size, the power of the size in inclusion, documents a bin, the share of a source that is its most.
STEPS, TILT, FULL, MOST = 4, 0.5, 256, 3
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size and target, from a row for each source.

    Sources weigh 1, 2, 3, repeating, by code point with null last. With sources in the order in which they reach their
    most as all targets rise by weight, the first one that stays below it fixes the level of all after it.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())  # a row for each source
    weighed = sizes.select("source", "source_size", ((F.row_number().over(order) - 1) % 3 + 1).alias("weight"))
    reach = weighed.withColumn("full", MOST * F.col("source_size") / F.col("weight"))
    rising = W.orderBy("full", F.col("source").asc_nulls_last())
    level = (
        F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum(MOST * F.col("source_size")).over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ) / F.sum("weight").over(rising.rowsBetween(0, W.unboundedFollowing))
    levels = reach.withColumn("level", level).withColumn("place", F.row_number().over(rising))
    fixed = F.min(F.when(F.col("level") <= F.col("full"), F.struct("place", "level"))).over(W.partitionBy())["level"]
    most = (MOST * F.col("source_size")).cast("double")
    return levels.select("source", "source_size", F.least(most, F.coalesce(fixed * F.col("weight"), most)).alias("target"))


def _tier(size: Column) -> Column:
    return F.when(size > 0, F.floor(F.log2(size) * STEPS)).otherwise(-1).cast("int")


def plan(sized: DataFrame) -> DataFrame:
    """A row for each source and tier: source_size, target, copies, n_docs, the sum of size ** -TILT, and n_more, how many
    of its documents are taken once more."""
    weight = F.when(F.col("size") > 0, F.pow("size", F.lit(-TILT))).otherwise(0.0)
    tiers = stage(sized.groupBy("source", "tier").agg(F.count("*").alias("n_docs"), F.sum("size").alias("words"), F.sum(F.col("size") * weight).alias("tilted"), F.sum(weight).alias("weights")), "mix-tiers")
    goals = targets(tiers.groupBy("source").agg(F.sum("words").alias("source_size"))).withColumnRenamed("source", "of")
    rows = tiers.join(goals, tiers.source.eqNullSafe(goals.of)).drop("of")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("copies", F.floor(ratio)).withColumn("need", F.greatest(F.col("target") - F.col("copies") * F.col("source_size"), F.lit(0.0)))
    # Small sizes reach a probability of 1 first: the first tier that stays below it fixes the level of all above it.
    up = W.partitionBy("source").orderBy("tier")  # some tens of rows a source
    level = (F.col("need") - F.coalesce(F.sum("words").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))) / F.sum("tilted").over(up.rowsBetween(0, W.unboundedFollowing))
    used = rows.where("tier >= 0").withColumn("level", level)
    open_ = F.when(F.col("level") * F.col("tilted") <= F.col("words"), F.struct("tier", "level"))
    fixed = F.min(open_).over(W.partitionBy("source"))["level"]
    expected = F.least(F.coalesce(fixed * F.col("tilted"), F.col("words").cast("double")), F.col("words").cast("double"))
    used = used.withColumn("expected", expected).withColumn("each", F.col("tilted") / F.col("weights"))
    # From the largest tier down, each gives the whole number nearest to what is expected of it and left by those before.
    of = used.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("tier", "expected", "each", "n_docs")), asc=False).alias("tiers"))  # some tens
    none = F.array().cast("array<struct<tier:int,n_more:bigint>>")

    def give(acc: Column, t: Column) -> Column:
        open_words = acc["open"] + t["expected"]
        n = F.least(F.greatest(F.round(open_words / t["each"]), F.lit(0.0)), t["n_docs"].cast("double")).cast("long")
        return F.struct((open_words - n * t["each"]).alias("open"), F.concat(acc["out"], F.array(F.struct(t["tier"].alias("tier"), n.alias("n_more")))).alias("out"))

    given = of.select(F.col("source").alias("of"), F.explode(F.aggregate("tiers", F.struct(F.lit(0.0).alias("open"), none.alias("out")), give, lambda acc: acc["out"])).alias("g")).select("of", F.col("g.tier").alias("at"), "g.n_more")
    met = rows.join(given, rows.source.eqNullSafe(given.of) & (rows.tier == given["at"]), "left")
    return met.select("source", "tier", "source_size", "target", "copies", "n_docs", "weights", F.coalesce("n_more", F.lit(0)).alias("n_more"))


def inclusion(size: Column) -> Column:
    """The probability that a document of a planned tier is taken once more."""
    return F.when(F.col("n_more") == 0, 0.0).when(F.col("n_more") >= F.col("n_docs"), 1.0).otherwise(F.least(F.col("n_more") * F.pow(size, F.lit(-TILT)) / F.col("weights"), F.lit(1 - 1e-12)))


def mix(docs: DataFrame, seed: int = 20) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken, inclusion, source, and a key of its text."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_key"))
    sized = stage(rows.withColumn("tier", _tier(F.col("size"))), "mix-sizes")
    plans = stage(plan(sized), "mix-plan").withColumnRenamed("source", "of").withColumnRenamed("tier", "at")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + 0.5) / float(1 << 53)
    p = F.col("inclusion")
    odds = (u / (1 - u)) / (p / (1 - p))
    known = sized.join(plans, sized.source.eqNullSafe(plans.of) & (sized.tier == plans["at"])).withColumn("inclusion", inclusion(F.col("size")))
    known = known.withColumn("rank", F.when((p > 0) & (p < 1), odds / (1 + odds))).withColumn("bin", F.floor(F.col("rank") * F.ceil(F.col("n_docs") / FULL)))
    ranked = stage(known.select("doc_id", "source", "size", "text_key", "tier", "source_size", "target", "copies", "n_more", "inclusion", "rank", "bin"), "mix-ranks")
    # The bin of each tier in which its number runs out, and how many of that bin are taken.
    bins = ranked.where("rank IS NOT NULL").groupBy("source", "tier", "bin").agg(F.count("*").alias("n"), F.first("n_more").alias("n_more"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source", "tier").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cuts = bins.withColumn("before", before).where((F.col("before") < F.col("n_more")) & (F.col("before") + F.col("n") >= F.col("n_more")))
    cuts = cuts.select(F.col("source").alias("of"), F.col("tier").alias("at"), F.col("bin").alias("cut"), (F.col("n_more") - F.col("before")).alias("left"))
    met = ranked.join(cuts, ranked.source.eqNullSafe(cuts.of) & (ranked.tier == cuts["at"]), "left")
    edge = F.coalesce(F.col("bin") == F.col("cut"), F.lit(False))
    place = F.rank().over(W.partitionBy("source", "tier").orderBy("rank", "doc_id", "text_key"))  # the rows of one bin a tier
    plain = met.where(~edge).withColumn("more", F.when(F.col("rank").isNull(), F.col("inclusion") == 1).otherwise(F.coalesce(F.col("bin") < F.col("cut"), F.lit(False))))
    cut = met.where(edge).withColumn("more", place <= F.col("left"))
    taken = F.col("size") * (F.col("copies") + F.col("more").cast("int"))
    drop(sized)
    return plain.unionByName(cut).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "inclusion", "source", "text_key")


def mixed(docs: DataFrame, seed: int = 20) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes it."""
    takes = mix(docs, seed).where("taken > 0").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), F.col("source").alias("of"), (F.col("taken") / F.col("size")).cast("int").alias("times")).distinct()
    # The rows of docs stand in a struct, so that their columns may have any names.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(takes.id) & (F.xxhash64("row.text") == takes.key) & F.col("row.source").cast("string").eqNullSafe(takes.of)
    return rows.join(takes, same).select("row", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy")).select("row.*")
