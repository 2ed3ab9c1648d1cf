"""Fields of a finding from its block by rule: sections that labels open, and the parts of web instances.

An extractor that needs no service: a label stays in force until the next one. Sections come from one pass over a block's
lines; the parts of instances from a window over them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from siftwell.operators.segment import BLANKS
from siftwell.plans.staging import ship_package

# Section titles of network reports and the record's fields for them.
SECTIONS = {
    "summary": "description", "vulnerability detection result": "detection_result", "vulnerability detection method": "detection_method", "product detection result": "product_detection_result",
    "impact": "impact", "solution": "solution", "vulnerability insight": "insight", "log method": "log_method", "references": "references",
}
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "LOG")


def _lines(blocks: DataFrame) -> DataFrame:
    rows = blocks.select("report_id", "block_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return rows.select("report_id", "block_id", "pos", F.regexp_replace("raw", r"^\s+|\s+$", "").alias("line"))


def reference_parts(lines: Column) -> Column:
    """One reference each: labels off, commas apart, numbers of a BID list labelled."""

    def parts(line: Column) -> Column:
        bid = F.regexp_like(line, F.lit(r"(?i)^bid\s*:"))
        bare = F.regexp_replace(line, r"(?i)^(cve|bid|other|url|cert)\s*:\s*", "")
        each = F.filter(F.transform(F.split(bare, ","), lambda x: F.trim(x)), lambda x: x != "")
        return F.transform(each, lambda x: F.when(bid & F.regexp_like(x, F.lit(r"^\d+$")), F.concat(F.lit("BID:"), x)).otherwise(x))

    return F.flatten(F.transform(lines, parts))


@pandas_udf(ArrayType(ArrayType(StringType())))
def _sections(texts: pd.Series) -> pd.Series:
    """The lines of a block's name and of each of SECTIONS' fields, in that order; a label stays in force until the next."""
    fields = {title: i for i, title in enumerate(SECTIONS, 1)}
    out = []
    for text in texts:
        lists, at = [[] for _ in range(len(SECTIONS) + 1)], -1
        for raw in (text or "").split("\n"):
            line = raw.strip(BLANKS)
            if line.startswith("NVT: "):
                at, line = 0, line[5:]
            elif (label := fields.get((line[:-1] if line.endswith(":") else line).lower(), -1)) >= 0:
                at = label
                continue
            if line and at >= 0:
                lists[at].append(line)
        out.append(lists)
    return pd.Series(out, dtype="object")


def network_fields(blocks: DataFrame) -> DataFrame:
    """report_id, block_id, name, severity, cvss, port, protocol and a list for each section, of a network scan's blocks.

    All comes from a block's own row, without a shuffle.
    """
    ship_package(blocks.sparkSession)
    held = blocks.select("report_id", "block_id", "text", "port", "protocol", _sections("text").alias("held"))
    part = {f: F.get("held", F.lit(i)) for i, f in enumerate(["name", *SECTIONS.values()])}
    head = lambda k: F.nullif(F.regexp_extract("text", r"(?m)^\s*(Critical|High|Medium|Low|Log)\s+\(CVSS:\s*([\d.]+)\)", k), F.lit(""))
    inside = lambda k: F.nullif(F.regexp_extract("text", r"(?i)\b(\d{1,5})/(tcp|udp)\b", k), F.lit(""))
    fields = [reference_parts(part[f]).alias(f) if f == "references" else part[f].alias(f) for f in SECTIONS.values()]
    return held.select(
        "report_id", "block_id", F.array_join(part["name"], " ").alias("name"), F.upper(head(1)).alias("severity"), head(2).try_cast("double").alias("cvss"),
        F.coalesce(inside(1), "port").alias("port"), F.coalesce(F.lower(inside(2)), F.when(F.col("protocol").isin("tcp", "udp"), F.col("protocol"))).alias("protocol"), *fields)


def instances(blocks: DataFrame) -> DataFrame:
    """report_id, block_id, instance_no and the ten parts of each instance of web blocks; a lone hyphen is empty."""
    order = W.partitionBy("report_id", "block_id").orderBy("pos")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    up = F.upper("line")
    rows = _lines(blocks).withColumn("up", up).withColumn("instance_no", F.sum((up == "INSTANCE").cast("int")).over(upto)).where("instance_no > 0")
    labels = ("INSTANCE", "PROOF", "OUTPUT", "IDENTIFICATION", "HTTP INFO", "REQUEST MADE", "REQUEST HEADERS", "RESPONSE HEADERS", "PAYLOAD")
    inline = F.regexp_like("up", F.lit("^(INPUT TYPE|INPUT NAME|PAYLOAD)"))
    rows = rows.withColumn("opens", F.when(F.col("up").isin(*labels), F.col("up")).when(inline, "INLINE"))
    rows = rows.withColumn("mode", F.last("opens", ignorenulls=True).over(upto)).withColumn("before", F.lag("up").over(order))
    clean = lambda c: F.when(F.trim(c) == "-", "").otherwise(F.trim(c))
    after = lambda label: F.when((F.col("before") == label) & F.col("opens").isNull(), F.col("line"))
    tail = lambda label: F.when(F.startswith("up", F.lit(label)) & (F.col("up") != label), F.substring("line", len(label) + 1, 1 << 20))
    text = lambda mode: clean(F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("mode") == mode) & F.col("opens").isNull() & (F.col("line") != ""), F.struct("pos", "line")))), lambda x: x["line"]), " "))
    request = F.when((F.col("before") == "REQUEST MADE"), F.col("line"))
    header = F.when(F.col("mode") == "RESPONSE HEADERS", F.col("line"))
    got = lambda c, p, k: F.coalesce(F.max(F.nullif(F.regexp_extract(c, p, k), F.lit(""))), F.lit(""))
    first = lambda c: clean(F.coalesce(F.min_by(c, F.when(c.isNotNull(), F.col("pos"))), F.lit("")))
    return rows.groupBy("report_id", "block_id", "instance_no").agg(
        first(after("INSTANCE")).alias("instance"), first(tail("INPUT TYPE")).alias("input_type"), first(tail("INPUT NAME")).alias("input_name"), first(F.coalesce(after("PAYLOAD"), tail("PAYLOAD"))).alias("payload"),
        text("PROOF").alias("proof"), text("OUTPUT").alias("output"), got(request, r"^([A-Z]+)\s+\S+\s+(HTTP/[\d.]+)$", 1).alias("request_method"), got(request, r"^([A-Z]+)\s+\S+\s+(HTTP/[\d.]+)$", 2).alias("http_protocol"),
        F.max(F.regexp_extract(header, r"^HTTP/[\d.]+\s+(\d{3})\b", 1).try_cast("int")).alias("http_status_code"), got(header, r"(?i)^content-type:\s*([^;]+)", 1).alias("response_content_type"))


def annotated(baseline: DataFrame, blocks: DataFrame) -> DataFrame:
    """baseline (plugin, ...) with the instances of its plugin's blocks, [] without any."""
    plugin = blocks.select("report_id", "block_id", F.regexp_extract("text", r"(?i)VULNERABILITY\s+\w+\s+PLUGIN\s+ID\s+(\d+)", 1).try_cast("long").alias("plugin"))
    found = instances(blocks).join(plugin.where("plugin IS NOT NULL"), ["report_id", "block_id"])
    names = [c for c in found.columns if c not in ("report_id", "block_id", "instance_no", "plugin")]
    lists = found.groupBy("plugin").agg(F.transform(F.array_sort(F.collect_list(F.struct("report_id", "block_id", "instance_no", *names))), lambda x: F.struct(*[x[n].alias(n) for n in names])).alias("instances"))
    rows = baseline.drop("instances").join(lists, "plugin", "left")
    return rows.withColumn("instances", F.coalesce("instances", F.array().cast(dict(rows.dtypes)["instances"])))
