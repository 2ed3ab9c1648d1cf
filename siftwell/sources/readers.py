"""Files to DataFrames. Nothing here lists or opens a file on the driver; paths may be any that Spark reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.functions.similarity import nfkc
from siftwell.functions.text import clean_page, clean_text

RECORD = """name string, description array<string>, solution array<string>, impact array<string>, references array<string>, severity string, host string, port string, protocol string, source string"""


def report_files(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """report_id (the file's path), stem and text of every report below a folder; form feeds part pages."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    file = F.col("_metadata.file_path")
    rows = rows.select(file.alias("report_id"), F.regexp_extract(file, r"([^/]+?)(\.[^./]*)?$", 1).alias("stem"), F.col("value").alias("raw"))
    pages = F.transform(F.split("raw", "\f", -1), lambda p: clean_page(p))
    return rows.select("report_id", "stem", clean_text(F.array_join(pages, ""), nfkc).alias("text"), F.size(pages).alias("page_count"))


def empty_reports(reports: DataFrame) -> DataFrame:
    return reports.where(F.trim(F.regexp_replace("text", r"\s+", "")) == "").select("report_id")


def scanner_of(path: Column, known: list[str], forced: str | None = None) -> Column:
    """The forced scanner, or the report's folder if a scanner has that name; else null."""
    folder = F.lower(F.try_element_at(F.split(path, "/"), F.lit(-2)))
    return F.lit(forced) if forced else F.when(folder.isin(*known), folder)


def results(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """Records of JSON array files, in the file's order (seq)."""
    rows = spark.read.option("multiLine", True).schema(RECORD + (", " + extra if extra else "")).json(path)
    return rows.withColumn("seq", F.monotonically_increasing_id())


def kev(spark: SparkSession, path: str) -> DataFrame:
    """Known exploited vulnerabilities: cve, distinct, in upper case."""
    rows = spark.read.option("multiLine", True).schema("vulnerabilities array<struct<cveID:string>>").json(path)
    return rows.select(F.explode("vulnerabilities").alias("v")).select(F.upper("v.cveID").alias("cve")).where("cve IS NOT NULL").distinct()


def epss(spark: SparkSession, path: str) -> DataFrame:
    """Exploit scores: cve and epss of a CSV with a comment line; of repeated ids the last row counts."""
    rows = spark.read.option("header", True).option("comment", "#").schema("cve string, epss string, percentile string").csv(path)
    return rows.withColumn("k", F.monotonically_increasing_id()).groupBy(F.upper("cve").alias("cve")).agg(F.max_by(F.col("epss").try_cast("double"), "k").alias("epss"))


def score_date(spark: SparkSession, path: str) -> DataFrame:
    """The date in the feed's comment line."""
    return spark.read.text(path).where("value LIKE '#%'").select(F.regexp_extract("value", r"score_date:([0-9T:\-]+)", 1).alias("score_date"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Runs of experiment manifests (JSON with a list `runs`)."""
    kind = "runs array<struct<scanner:string,model:string,run:int,report:string,run_dir:string,status:string,duration_s:double,cost_usd:double,coverage:struct<recall:double,precision:double,matched:int,baseline_count:int,false_negatives:array<string>,false_positives:array<string>,missed:array<string>,spurious:array<string>>>>"
    rows = spark.read.option("multiLine", True).schema(kind).json(path).select(F.explode("runs").alias("r")).select("r.*")
    size = lambda new, old: F.size(F.coalesce(F.col(f"coverage.{new}"), F.col(f"coverage.{old}")))
    return rows.withColumn("false_negatives", size("false_negatives", "missed")).withColumn("false_positives", size("false_positives", "spurious"))


def csv_export(spark: SparkSession, path: str) -> DataFrame:
    """A scanner's CSV export with its header, quoted line breaks and the file's order in pos."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.toDF(*[c.lstrip("\ufeff") for c in rows.columns]).withColumn("pos", F.monotonically_increasing_id())


def floating_header_export(spark: SparkSession, path: str, first: tuple[str, str] = ("IP", "DNS"), width: int = 40) -> DataFrame:
    """A CSV whose header is not its first row: rows after the one that begins with `first`, as maps of header to cell."""
    names = [f"c{k}" for k in range(width)]
    rows = spark.read.option("multiLine", True).option("escape", '"').schema(", ".join(f"{n} string" for n in names)).csv(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos"), F.array(*names).alias("cells"))
    head = rows.where((F.col("cells")[0] == first[0]) & (F.col("cells")[1] == first[1])).groupBy("file").agg(F.min(F.struct("pos", "cells")).alias("h"))
    keys = F.filter("h.cells", lambda c: c.isNotNull())
    return rows.join(head, "file").where(F.col("pos") > F.col("h.pos")).select("file", "pos", F.map_from_arrays(keys, F.slice("cells", F.lit(1), F.size(keys))).alias("row"))


def overlaid(baseline: DataFrame, overlay: DataFrame, column: str, order: str = "pos") -> DataFrame:
    """baseline with a column of the overlay by position; unchanged if the two have different numbers of rows."""
    if baseline.count() != overlay.count():
        return baseline
    number = lambda df: df.withColumn("place", F.row_number().over(W.orderBy(order)))  # noqa: E731  ground truth of one report
    return number(baseline).drop(column).join(number(overlay).select("place", column), "place").drop("place")
