"""Ground truth from scanner exports, and comparisons of result sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.functions.scoring import render_text
from siftwell.functions.similarity import identifiers
from siftwell.functions.text import unix_lines
from siftwell.operators.consolidate import first_of
from siftwell.operators.schema import SEVERITIES

TIERS = {"1": "LOG", "2": "LOW", "3": "MEDIUM", "4": "HIGH", "5": "CRITICAL"}


def flat_references(cves: Column, bids: Column, certs: Column, other: Column) -> Column:
    """One list of references: comma parts, numbers of BIDs labelled."""
    parts = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.concat(parts(cves), F.transform(parts(bids), lambda x: F.when(F.regexp_like(x, F.lit(r"^\d+$")), F.concat(F.lit("BID:"), x)).otherwise(x)), parts(certs), parts(other))


def network_baseline(export: DataFrame) -> DataFrame:
    """The first row for each name, host, port and protocol of a network scan's CSV export; pos is the file's order."""
    rows = first_of(export, ("NVT Name", "IP", "Port", "Port Protocol"), "pos")
    text = lambda c: unix_lines(F.col(f"`{c}`"))
    return rows.select("pos", text("NVT Name").alias("name"), text("IP").alias("host"), text("Port").alias("port"), F.lower(text("Port Protocol")).alias("protocol"), text("Summary").alias("description"), text("Solution").alias("solution"), text("Impact").alias("impact"), F.upper(text("Severity")).alias("severity"), F.col("CVSS").try_cast("double").alias("cvss"), flat_references(F.col("CVEs"), F.col("BIDs"), F.col("CERTs"), F.col("Other References")).alias("references"))


def tier(severity: Column) -> Column:
    out = severity
    for k, v in TIERS.items():
        out = F.when(severity == k, v).otherwise(out)
    return out


def severity_tier(value: Column) -> Column:
    """A severity in upper case if it is one of the record format's, else as it is without outer blanks."""
    text = F.trim(value.cast("string"))
    return F.when(F.upper(text).isin(*SEVERITIES), F.upper(text)).otherwise(text)


def reference_list(cell: Column) -> Column:
    """A cell of references as a list: a written list of quoted texts, lines, or one text; empty cells are empty lists."""
    text = F.trim(F.coalesce(cell.cast("string"), F.lit("")))
    quoted = F.from_json(F.regexp_replace(text, r"(?<=[\[,\s])'([^']*)'(?=\s*[,\]])", '"$1"'), "array<string>")
    lines = F.split(text, r"\r\n|[\n\r]")
    items = F.when(F.startswith(text, F.lit("[")), F.coalesce(quoted, lines)).otherwise(lines)
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))


def canonical(rows: DataFrame, columns: list[str], dropped: tuple[str, ...] = ()) -> DataFrame:
    """The columns of a record type first, missing ones empty, then further ones in their order without the dropped."""
    own = [F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]
    return rows.select(*own, *[F.col(f"`{c}`") for c in rows.columns if c not in columns and c not in dropped])


def changed_cells(before: DataFrame, after: DataFrame, fields: list[str], key: str = "pos") -> DataFrame:
    """field, the first place at which two versions differ in content, and how many do: references as sets of identifiers,
    severities in any case, other cells by their text."""
    kinds = dict(zip(before.columns, (f.dataType for f in before.schema.fields)))
    both = before.select(key, F.struct(*fields).alias("b")).join(after.select(key, F.struct(*[F.col(f).cast(kinds[f]).alias(f) for f in fields]).alias("a")), key, "full")

    def content(side: Column, name: str) -> Column:
        if name == "references":
            return F.array_join(F.array_sort(identifiers(render_text(side[name], kinds[name]))), "\n")
        text = render_text(side[name], kinds[name])
        return F.upper(text) if name == "severity" else text

    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (~content(F.col("b"), f).eqNullSafe(content(F.col("a"), f))).alias("differs")) for f in fields]))
    return both.select(key, cells.alias("c")).where("c.differs").groupBy(F.col("c.field").alias("field")).agg(F.min(key).alias("first"), F.count("*").alias("n"))


def name_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: distinct names of each side, in both, only in one, and the share of both in the union."""
    rows = left.select("name").distinct().withColumn("l", F.lit(1)).join(right.select("name").distinct().withColumn("r", F.lit(1)), "name", "full")
    out = rows.agg(F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n_both"), F.count("*").alias("n_union"))
    return out.select("n_left", "n_right", "n_both", (F.col("n_left") - F.col("n_both")).alias("only_left"), (F.col("n_right") - F.col("n_both")).alias("only_right"), F.round(F.try_divide("n_both", "n_union"), 4).alias("overlap"))


def energy(samples: DataFrame, device: str = "device", t: str = "t", power: str = "power") -> DataFrame:
    """device: mean and peak power and watt-hours by the trapezoid rule between neighbouring samples; null power pairs are left out.

    Samples of a device are cut into spans of an hour so that no device is one task; the first sample of the next span
    closes the one before.
    """
    span = F.floor(F.col(t) / 3600).cast("long")
    rows = samples.select(device, F.col(t).alias("t"), F.col(power).alias("p")).withColumn("span", span)
    inside = W.partitionBy(device, "span").orderBy("t", "p")
    led = rows.withColumn("t2", F.lead("t").over(inside)).withColumn("p2", F.lead("p").over(inside)).withColumn("has_next", F.lead(F.lit(1)).over(inside).isNotNull())
    heads = rows.groupBy(device, "span").agg(F.min(F.struct("t", "p")).alias("head"))
    nexts = heads.withColumn("after", F.lead("head").over(W.partitionBy(device).orderBy("span"))).select(device, "span", "after")
    both = led.join(nexts, [device, "span"]).withColumn("t2", F.when(F.col("has_next"), F.col("t2")).otherwise(F.col("after.t"))).withColumn("p2", F.when(F.col("has_next"), F.col("p2")).otherwise(F.col("after.p")))
    area = (F.col("p") + F.col("p2")) / 2 * (F.col("t2") - F.col("t"))
    return both.groupBy(device).agg(F.count("*").alias("n"), F.round(F.avg("p"), 4).alias("mean_power"), F.max("p").alias("peak_power"), F.round(F.coalesce(F.sum(area), F.lit(0.0)) / 3600, 4).alias("watt_hours"))
