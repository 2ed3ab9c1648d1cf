"""Records that belong together to one: structural pairing by key, then exact repeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from siftwell.functions.text import normal_name


def filled(value: Column, kind: DataType) -> Column:
    """Null, empty texts and empty lists aren't filled; numbers (also 0) and objects are."""
    if isinstance(kind, (ArrayType, MapType)):
        return F.coalesce(F.size(value) > 0, F.lit(False))
    if isinstance(kind, StringType):
        return F.coalesce(value != "", F.lit(False))
    if isinstance(kind, StructType):
        return F.lit(True)
    return value.isNotNull()


def completeness(record: Column, fields: StructType) -> Column:
    return sum((filled(record[f.name], f.dataType).cast("int") for f in fields), F.lit(0))


def pair_name(name: Column, suffix: str | None) -> Column:
    """The name by which records pair: without the suffix, normalised."""
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), "(?i)" + suffix, "") if suffix else name
    return normal_name(bare)


def paired(records: DataFrame, by: Sequence[str], suffix: str | None = r"\s*Instances\s*(\(\d+\))?\s*$", instances: str | None = "instances", seq: str = "seq", name: str = "name") -> DataFrame:
    """One record of each (report, pair name, by): a fold in order of seq.

    Instances are added up first; then the more complete record wins (the earlier one if equal) and takes from the other
    what it lacks. The survivor keeps the place of the first. `merged` counts the records that went into it.
    """
    fields = StructType([f for f in records.schema if f.name not in (seq, "report_id")])
    record = F.struct(*[F.col(f"`{f.name}`") for f in fields])
    keyed = records.withColumn("pair_key", F.struct(pair_name(F.col(name), suffix).alias("pair_name"), *by))
    has = instances if instances in records.columns else None

    def with_instances(r: Column, more: Column) -> Column:
        return r.withField(has, more) if has else r

    def merge(kept: Column, new: Column) -> Column:
        more = F.concat(F.coalesce(kept[has], F.array()), F.coalesce(new[has], F.array())) if has else None
        kept = with_instances(kept, more)
        take = lambda a, b: F.struct(*[(a[f.name] if f.name == has else F.when(filled(a[f.name], f.dataType), a[f.name]).otherwise(b[f.name])).alias(f.name) for f in fields])
        return F.when(completeness(new, fields) > completeness(kept, fields), take(with_instances(new, more), kept)).otherwise(take(kept, new))

    rows = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), record.alias("r"))))
    grouped = keyed.groupBy("report_id", "pair_key").agg(rows.alias("rows"))
    first = F.element_at("rows", 1)
    kind = fields.simpleString()
    out = F.aggregate(F.slice("rows", 2, F.size("rows")), first["r"].cast(kind), lambda a, x: merge(a, x["r"].cast(kind)).cast(kind))
    return grouped.select("report_id", first["seq"].alias(seq), out.alias("r"), F.size("rows").alias("merged")).select("report_id", seq, "r.*", "merged")


def without_repeats(records: DataFrame, seq: str = "seq", name: str = "name") -> DataFrame:
    """The first of records of a report that are equal in all fields, names compared normalised; `repeats` counts them."""
    rest = [c for c in records.columns if c not in (seq, name, "report_id")]
    key = F.to_json(F.struct(normal_name(F.col(name)).alias("n"), *[F.col(f"`{c}`") for c in rest]), {"ignoreNullFields": "false"})
    keyed = records.withColumn("identity", F.sha2(key, 256))
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in records.columns]), seq)
    return keyed.groupBy("report_id", "identity").agg(first.alias("first"), F.count("*").cast("int").alias("repeats")).select("first.*", "repeats")


def merge_log(records: DataFrame, count: str = "merged") -> DataFrame:
    return records.where(F.col(count) > 1).select("report_id", "seq", F.format_string("merged %d records into '%s'", F.col(count), F.col("name")).alias("message"))


def first_of(records: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row for each key in the given order."""
    return records.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("place = 1").drop("place")


def counts(raw: DataFrame, final: DataFrame) -> DataFrame:
    """report_id, raw, final: records before and after consolidation; reports that have none left count too."""
    of = lambda df, name: df.groupBy("report_id").agg(F.count("*").alias(name))
    return of(raw, "raw").join(of(final, "final"), "report_id", "left").fillna(0, ["final"])
