"""A remediation queue from exploit intelligence: which findings to act on first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.functions.text import once
from siftwell.plans.staging import drop, stage

LIKELY = 0.10
# Suffixes of internal names; what to do for (exploitation, exposure, severity).
INTERNAL_SUFFIXES = (".local", ".internal", ".lan", ".home", ".corp", ".intranet")
CATEGORIES = ("Act", "Attend", "Track*", "Track")
DECISIONS = """
active exposed high Act
active exposed medium Act
active exposed low Attend
active internal high Act
active internal medium Attend
active internal low Track*
likely exposed high Act
likely exposed medium Attend
likely exposed low Track*
likely internal high Attend
likely internal medium Track*
likely internal low Track
none exposed high Attend
none exposed medium Track*
none exposed low Track
none internal high Track*
none internal medium Track
none internal low Track
unknown exposed high Act
unknown exposed medium Attend
unknown exposed low Track*
unknown internal high Attend
unknown internal medium Track*
unknown internal low Track
"""
#: IPv4 ranges that are not reachable from outside, as first and last address.
INTERNAL_RANGES = (
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"), ("192.0.0.0", "192.0.0.8"), ("192.0.0.11", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"), ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"), ("240.0.0.0", "255.255.255.255"),
)
EXPLOITS = {"active": "active exploitation (KEV)", "likely": "likely exploitation (EPSS)", "none": "no known exploitation", "unknown": "no CVE to assess exploitation"}


def cves(text: Column, pattern: str = r"(?i)CVE-\d{4}-\d+") -> Column:
    """Distinct vulnerability ids in upper case, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda c: F.upper(c)))


def hostname(host: Column) -> Column:
    """Without scheme, path, query, port and brackets, in lower case."""
    out = F.regexp_replace(F.trim(host), r"(?i)^[a-z][a-z0-9+.\-]*://", "")
    out = F.regexp_replace(out, r"[/?].*$", "")
    colons = F.length(out) - F.length(F.replace(out, F.lit(":"), F.lit("")))
    out = F.when(colons == 1, F.regexp_replace(out, r":[^:]*$", "")).otherwise(out)
    return F.lower(F.regexp_replace(out, r"^[\[\]]+|[\[\]]+$", ""))


def _number(dotted: str) -> int:
    a, b, c, d = map(int, dotted.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def exposure(host: Column) -> Column:
    """internal where the host is surely private, else exposed."""

    def private(number: Column) -> Column:
        out = F.lit(False)
        for low, high in INTERNAL_RANGES:
            out = out | number.between(_number(low), _number(high))
        return out

    def inside(name: Column) -> Column:
        is_ip = F.regexp_like(name, F.lit(r"^(0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])(\.(0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])){3}$"))
        number = F.aggregate(F.split(name, r"\."), F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
        named = ~F.contains(name, F.lit(".")) | F.regexp_like(name, F.lit("(" + "|".join(s.replace(".", r"\.") for s in INTERNAL_SUFFIXES) + ")$"))
        v6 = F.regexp_like(name, F.lit(r"^[0-9a-f:]*::?[0-9a-f:.]*$")) & F.contains(name, F.lit(":"))
        v6_private = F.regexp_like(name, F.lit(r"^(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)$"))
        return F.when(name == "", False).when(is_ip, once(number, private)).when(v6, v6_private).otherwise(named)

    return F.when(once(F.coalesce(hostname(host), F.lit("")), inside), "internal").otherwise("exposed")


def band(cvss: Column, severity: Column) -> Column:
    """high, medium or low by a positive score, else by the label."""
    word = F.lower(F.coalesce(severity, F.lit("")))
    label = F.when(word.isin("critical", "high"), "high").when(word == "medium", "medium").otherwise("low")
    return F.when(cvss > 0, F.when(cvss >= 7, "high").when(cvss >= 4, "medium").otherwise("low")).otherwise(label)


def ranked(df: DataFrame, keys: list[Column], into: str = "rank") -> DataFrame:
    """df with its place in the order of keys (which must tell all rows apart), from 1, sorted in ranges side by side.

    Whole rows are shuffled once: a range is sorted and numbered as it is written, and the ranges' sizes give what to add.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    whole = stage(df, "rank-rows")  # ranges are found by a sample of the rows, so these are worked out first
    # The number holds the range above bit 33 and the place in it, from 0, below.
    parts = stage(whole.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("range_at", F.monotonically_increasing_id()), "ranks")
    drop(whole)
    parts = parts.withColumn("range_id", F.shiftright("range_at", 33))
    # A row for each range.
    sizes = parts.groupBy("range_id").agg(F.count("*").alias("range_rows"))
    before = sizes.select("range_id", F.coalesce(F.sum("range_rows").over(W.orderBy("range_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("rows_before"))
    out = parts.join(F.broadcast(before), "range_id")
    return out.withColumn(into, F.col("range_at").bitwiseAND((1 << 33) - 1) + F.col("rows_before") + 1).drop("range_at", "range_id", "rows_before")


def findings_of(records: DataFrame) -> DataFrame:
    """records (arrays references; a score, plugin_details and instances where they have them) as findings of the queue.

    Ids come from the references and from what the plugin's details hold as JSON; a record without a host takes the first
    instance that isn't empty.
    """
    has = set(records.columns)
    parts = [F.array_join("references", " "), *([F.to_json("plugin_details")] if "plugin_details" in has else [])]
    host = F.nullif(F.col("host"), F.lit(""))
    if "instances" in has:
        host = F.coalesce(host, F.try_element_at(F.filter(F.transform("instances", lambda x: x["instance"]), lambda u: u != ""), F.lit(1)))
    score = F.col("cvss_score") if "cvss_score" in has else F.lit(None)
    return records.select("seq", "name", host.alias("host"), "severity", score.cast("double").alias("cvss"), F.concat_ws(" ", *parts).alias("reference"))


def queue_of(records: DataFrame, kev: DataFrame, epss: DataFrame, snapshot_date: str = "") -> DataFrame:
    """The queue of records; without any row in both feeds there is nothing to rank by, which is an error."""
    if not kev.limit(1).count() and not epss.limit(1).count():
        raise ValueError("both exploit feeds are empty")
    return queue(findings_of(records), kev, epss, snapshot_date)


def queue(findings: DataFrame, kev: DataFrame, epss: DataFrame, snapshot_date: str = "") -> DataFrame:
    """findings (seq, name, host, severity, cvss, reference) to the ranked queue.

    Feeds meet the findings through the ids that these name; the feeds' size decides how (no hint is given).
    """
    spark = findings.sparkSession
    named = findings.select("seq", F.explode(cves(F.col("reference"))).alias("cve"))
    hits = named.join(epss, "cve", "left").join(kev.distinct().withColumn("known", F.lit(True)), "cve", "left")
    signals = hits.groupBy("seq").agg(F.coalesce(F.max("epss"), F.lit(0.0)).alias("epss"), F.coalesce(F.bool_or("known"), F.lit(False)).alias("kev"))
    # Rows are shuffled with short columns: what follows from the decision is one number, the category's place before that of the row.
    decisions = [tuple(x.split()) for x in DECISIONS.strip().splitlines()]
    numbered = [(CATEGORIES.index(d[3]) * len(decisions) + k, *d) for k, d in enumerate(decisions)]
    table = F.broadcast(spark.createDataFrame(numbered, "decision int, exploitation string, exposure string, severity_band string, category string"))  # 24 rows
    rows = findings.select("seq", "name", F.coalesce("host", F.lit("")).alias("host"), band(F.col("cvss"), F.col("severity")).alias("severity_band"), "cvss", F.array_join(cves(F.col("reference")), ", ").alias("cves"))
    rows = rows.join(signals, "seq", "left").fillna({"kev": False, "epss": 0.0})
    exploitation = F.when(F.col("cves") == "", "unknown").when(F.col("kev"), "active").when(F.col("epss") >= LIKELY, "likely").otherwise("none")
    rows = rows.select("seq", "name", "host", exposure(F.col("host")).alias("exposure"), exploitation.alias("exploitation"), "severity_band", "kev", F.round("epss", 5).alias("epss"), "cvss", "cves")
    rows = rows.join(table, ["exploitation", "exposure", "severity_band"]).select("seq", "name", "host", "kev", "epss", "cvss", "cves", "decision")
    out = ranked(rows, [F.floor(F.col("decision") / len(decisions)), F.desc("epss"), F.desc(F.coalesce("cvss", F.lit(0.0))), F.col("seq")]).join(table, "decision")
    said = F.create_map(*[F.lit(x) for kv in EXPLOITS.items() for x in kv])
    why = F.concat(said[F.col("exploitation")], F.lit("; "), F.when(F.col("exposure") == "exposed", "internet-exposed").otherwise("internal asset"), F.lit("; "), F.col("severity_band"), F.lit(" severity"))
    return out.select("rank", "seq", "name", "host", "category", "exposure", "exploitation", F.col("severity_band").alias("severity"), "kev", "epss", "cvss", "cves", why.alias("justification"), F.lit(snapshot_date).alias("snapshot_date"))
