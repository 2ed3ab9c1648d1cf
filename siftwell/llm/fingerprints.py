"""Document fingerprints by a homomorphic multiset hash; DataFrame functions only.

A text falls into passages (lines, cut again behind the punctuation marks that a blank follows and behind words of six
letters or more; each keeps its end, so passages joined are the text). Each passage is hashed to a wide vector and the
vectors are summed, each place modulo a power of two. So the order of passages doesn't matter, and a passage is put in or
taken out by adding or subtracting its vector. The vector's places are

* the number of passages and `DENSE` hashes of 32 bits, modulo 2^32, for equality;
* `PACKED` places of `LANES` counters of 15 bits each, modulo 2^60, for likeness: each counter sums one bit of the
  passage's hash, so twice the counter less the number of passages is a sum of random signs.

The squares of such sums estimate how often passages occur (each counted by the square of its repeats): S of both texts
together, D of the difference of the two vectors. Passages in common cancel in D, so the likeness (S - D) / (S + D), kept
within 0 and 1, is the share of passages in common with an error that comes from the others alone. For texts without
repeated passages this is the Jaccard share; the more counters, the less error (120: about 0.05 at a share of 0.6).

A counter's carry into its neighbour is left there: it is part of the sum, and moves a counter by one for every 32,768
passages, far below its spread.

Defined results: null and empty texts have the fingerprint of no passages, all zeros; two of these are equal, and one has a
likeness of 0 to any other text. The next document is the next by doc_id (a null id first, rows with one id by a hash of
their text), after the last the first. A single document is its own next. Repeated rows are each answered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DENSE, HASHES, LANES, BITS = 4, 2, 4, 15
PACKED = HASHES * BITS
MASK, WIDE = (1 << 32) - 1, (1 << LANES * BITS) - 1
#: One bit of each lane.
SPREAD = sum(1 << BITS * k for k in range(LANES))
PASSAGE_END = r"(?<=\n)|(?<= )(?<=[.!?,;|] |\p{L}{6} )"


def passages(text: Column) -> Column:
    return F.filter(F.split(text, PASSAGE_END, -1), lambda p: p != "")


def _sum(values: Column, value, mask: int) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: (a + value(x)).bitwiseAND(F.lit(mask)))


def _let(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def vector(parts: Column) -> Column:
    """The sum of the vectors of an array of passages: the count, DENSE places, PACKED places."""

    def of(hashes: Column) -> Column:
        again = lambda k: lambda h: F.xxhash64(F.lit(k), h)
        dense = [_sum(hashes, lambda h, k=k: F.xxhash64(F.lit(k), h).bitwiseAND(F.lit(MASK)), MASK) for k in range(1, DENSE + 1)]
        lanes = lambda hs: [_sum(hs, lambda h, k=k: F.shiftrightunsigned(h, k).bitwiseAND(F.lit(SPREAD)), WIDE) for k in range(BITS)]
        packed = [_let(F.transform(hashes, again(DENSE + k)), lambda hs: F.array(*lanes(hs))) for k in range(1, HASHES + 1)]
        return F.concat(F.array(F.size(hashes).cast("long"), *dense), *packed)

    return _let(F.transform(parts, lambda x: F.xxhash64(x)), of)


def shown(v: Column) -> Column:
    place = lambda x, i: F.when(i <= DENSE, F.lpad(F.lower(F.hex(x)), 8, "0")).otherwise(F.lpad(F.lower(F.hex(x)), LANES * BITS // 4, "0"))
    return F.array_join(F.transform(v, place), "")


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector of both multisets together, or with sign -1 of the first without the second."""
    place = lambda p, i: F.pmod(p["x"] + sign * p["y"], F.when(i <= DENSE, F.lit(MASK + 1)).otherwise(F.lit(WIDE + 1)))
    return F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), place)


def _signs(packed: Column, n: Column, lane: int) -> Column:
    """Twice a counter less n, taken for the number nearest to 0 that it can be."""
    half = 1 << BITS
    twice = F.shiftrightunsigned(packed, BITS * lane).bitwiseAND(F.lit(half - 1)) * 2 - n
    return F.pmod(twice + half, F.lit(2 * half)) - half


def likeness(a: Column, b: Column) -> Column:
    """Share of passages in common, from the vectors of both; 1 for equal ones."""
    zero = F.lit(0.0)

    def of(both: Column) -> Column:
        n, m = F.element_at(both["x"], 1), F.element_at(both["y"], 1)

        def add(acc: Column, p: Column) -> Column:
            total, apart = acc["total"], acc["apart"]
            for lane in range(LANES):
                x, y = _signs(p["x"], n, lane).cast("double"), _signs(p["y"], m, lane).cast("double")
                total, apart = total + x * x + y * y, apart + (x - y) * (x - y)
            return F.struct(total.alias("total"), apart.alias("apart"))

        rows = F.slice(F.arrays_zip(both["x"].alias("x"), both["y"].alias("y")), DENSE + 2, PACKED)
        share = F.aggregate(rows, F.struct(zero.alias("total"), zero.alias("apart")), add, lambda acc: F.try_divide(acc["total"] - acc["apart"], acc["total"] + acc["apart"]))
        return F.when((n == 0) | (m == 0), zero).otherwise(F.least(F.greatest(F.coalesce(share, zero), zero), F.lit(1.0)))

    return F.when(a == b, F.lit(1.0)).otherwise(_let(F.struct(a.alias("x"), b.alias("y")), of))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most the key, by halving."""

    def find(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key < bounds[mid], find(low, mid)).otherwise(find(mid + 1, high))

    return F.when(key.isNull(), F.lit(-1)).otherwise(find(0, len(bounds)))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, vector and those of the next document; documents meet their next without one task that sorts all."""
    spark = docs.sparkSession
    n = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)])).first()[0] or []  # n numbers, whatever the rows
    bounds = sorted(set(found))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("bucket", _bucket(F.col("doc_id"), bounds))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    within = W.partitionBy("bucket").orderBy(*order)
    # The first document of each bucket follows the last of the one before.
    ids = rows.groupBy("bucket").agg(F.min("doc_id").alias("first_id")).withColumnRenamed("bucket", "of")
    heads = rows.join(F.broadcast(ids), (rows.bucket == ids.of) & rows.doc_id.eqNullSafe(ids.first_id)).groupBy("bucket").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("head"))
    turn = W.orderBy("bucket")  # a row for each of at most n + 1 buckets
    every = W.partitionBy().orderBy("bucket").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(turn), F.first(c).over(every))
    heads = heads.withColumn("sums", vector(passages(F.col("head")))).withColumn("head", F.struct("head", "sums"))
    heads = heads.select(F.col("bucket").alias("of"), after("head").alias("after"))
    # Vectors are worked out behind the exchange that the window needs anyway: one task a bucket range, not one a file.
    own = rows.repartition("bucket").withColumn("sums", vector(passages(F.col("text"))))
    led = own.withColumn("led", F.lead(F.struct("text", "sums")).over(within))
    next_ = F.coalesce("led", F.struct(F.col("after.head").alias("text"), F.col("after.sums").alias("sums")))
    return led.join(heads, led.bucket == heads.of).select("doc_id", "text", "sums", next_.alias("next")).select("doc_id", "text", "sums", F.col("next.text").alias("next_text"), F.col("next.sums").alias("next_sums"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and the likenesses to that and to the next document."""
    k = F.floor(F.col("n_chars") / 4).cast("int")
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.left("text", F.col("n_chars").cast("int") - k), F.left("next_text", k)))
    rows = rows.withColumn("edited_sums", vector(passages(F.col("edited"))))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), shown(F.col("sums")).alias("fingerprint"), shown(F.col("edited_sums")).alias("edited_fingerprint"),
        likeness(F.col("sums"), F.col("edited_sums")).alias("near_edited"), likeness(F.col("sums"), F.col("next_sums")).alias("near_next"))
