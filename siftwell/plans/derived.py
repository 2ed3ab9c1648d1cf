"""Views derived from the driver tables by SQL that Spark and DuckDB read alike.

The driver tables hold no scan reports. These views give each operator of the engine inputs of its own shape: findings
with hosts and vulnerability ids, exploit feeds, report lines, extractor answers, ground truth and experiment runs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.plans.staging import table

FINDINGS = """
SELECT l_orderkey * 1000000 + l_partkey % 1000 * 1000 + l_suppkey % 100 * 10 + l_linenumber AS seq,
       l_orderkey, l_partkey, l_suppkey, l_linenumber,
       concat(p_name, ' ', p_type) AS name,
       CASE WHEN l_suppkey % 5 = 0 THEN concat('10.0.', CAST(l_suppkey % 200 AS VARCHAR(9)), '.', CAST(l_partkey % 250 AS VARCHAR(9)))
            WHEN l_suppkey % 5 = 1 THEN concat('198.51.101.', CAST(l_partkey % 250 AS VARCHAR(9)))
            WHEN l_suppkey % 5 = 2 THEN concat('srv', CAST(l_suppkey % 40 AS VARCHAR(9)))
            WHEN l_suppkey % 5 = 3 THEN concat('app', CAST(l_suppkey % 40 AS VARCHAR(9)), '.corp')
            ELSE concat('https://www', CAST(l_suppkey % 40 AS VARCHAR(9)), '.example.com:8443/a?b=1') END AS host,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity / 5 END AS cvss,
       CASE WHEN l_returnflag = 'A' THEN 'HIGH' WHEN l_returnflag = 'R' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
       CASE WHEN l_linenumber % 4 = 0 THEN 'general' ELSE CAST(l_partkey % 9000 AS VARCHAR(9)) END AS port,
       CASE WHEN l_linenumber % 2 = 0 THEN 'tcp' ELSE 'udp' END AS protocol,
       CASE WHEN l_linenumber % 3 = 0 THEN 'no reference'
            ELSE concat('see cve-', CAST(year(l_shipdate) AS VARCHAR(9)), '-', CAST(1000 + l_partkey AS VARCHAR(9)), ' and CVE-', CAST(year(l_shipdate) AS VARCHAR(9)), '-', CAST(1000 + l_partkey AS VARCHAR(9))) END AS reference,
       l_quantity, l_extendedprice, l_discount
FROM lineitem JOIN part ON l_partkey = p_partkey
"""

KEV = """
SELECT DISTINCT concat('CVE-', CAST(y AS VARCHAR(9)), '-', CAST(1000 + p_partkey AS VARCHAR(9))) AS cve
FROM part CROSS JOIN (SELECT 1996 AS y UNION ALL SELECT 1997) years WHERE p_partkey % 11 = 0
"""

EPSS = """
SELECT concat('CVE-', CAST(y AS VARCHAR(9)), '-', CAST(1000 + p_partkey AS VARCHAR(9))) AS cve, CAST(p_partkey * 37 % 1000 AS DOUBLE) / 1000 AS epss
FROM part CROSS JOIN (SELECT 1992 AS y UNION ALL SELECT 1993 UNION ALL SELECT 1994 UNION ALL SELECT 1995 UNION ALL SELECT 1996 UNION ALL SELECT 1997 UNION ALL SELECT 1998) years
"""

#: A network scan's report for each supplier: host lines, headers, markers, names and sections.
REPORT_LINES = """
SELECT l_suppkey AS report_id, seq * 10 + k AS pos,
       CASE WHEN k = 0 AND l_linenumber = 1 THEN concat('10.1.', CAST(l_suppkey % 200 AS VARCHAR(9)), '.', CAST(l_orderkey % 250 AS VARCHAR(9)))
            WHEN k = 1 AND l_linenumber = 1 THEN 'Host scan start today'
            WHEN k = 2 AND l_linenumber % 2 = 1 THEN concat('2.1 ', CASE WHEN severity = 'HIGH' THEN 'High' WHEN severity = 'MEDIUM' THEN 'Medium' ELSE 'Low' END, ' ', port, '/', protocol)
            WHEN k = 3 THEN concat(CASE WHEN severity = 'HIGH' THEN 'High' WHEN severity = 'MEDIUM' THEN 'Medium' ELSE 'Low' END, ' (CVSS: ', CAST(CAST(floor(l_quantity) AS INT) AS VARCHAR(9)), ')')
            WHEN k = 4 THEN concat('NVT: ', name)
            WHEN k = 5 AND l_linenumber = 2 THEN '2 RESULTS PER HOST 7'
            WHEN k = 6 THEN 'Summary'
            WHEN k = 7 THEN concat('Order ', CAST(l_orderkey AS VARCHAR(19)), '  was\tseen.')
            WHEN k = 8 AND l_linenumber = 3 THEN 'Page 3 of 9'
            ELSE '' END AS line
FROM findings CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8) steps
"""

#: Runs of an experiment: model, target, run, coverage and costs.
RUNS = """
SELECT o_orderkey AS run_id, o_orderpriority AS model, o_orderstatus AS target, o_orderkey % 3 AS run,
       CASE WHEN o_orderkey % 17 = 0 THEN 'failed' WHEN o_orderkey % 5 = 0 THEN 'cached' ELSE 'ok' END AS status,
       CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS DOUBLE) / 1000 AS recall,
       CAST(CAST(floor(o_totalprice) AS BIGINT) % 997 AS DOUBLE) / 1000 AS "precision",
       CAST(o_custkey % 7 AS INT) AS false_negatives, CAST(o_custkey % 5 AS INT) AS false_positives, CAST(20 + o_custkey % 30 AS INT) AS baseline_count,
       CAST(o_orderkey % 100 AS DOUBLE) / 1000 AS cost, CAST(o_orderkey % 900 AS DOUBLE) AS duration
FROM orders
"""

#: Scores of fields and metrics for pairs of a run.
PAIRS = """
SELECT l_orderkey AS run_id, l_linenumber * 100000 + l_partkey AS pair,
       CASE WHEN l_linenumber % 3 = 0 THEN 'description' WHEN l_linenumber % 3 = 1 THEN 'solution' ELSE 'impact' END AS field,
       CASE WHEN l_suppkey % 2 = 0 THEN 'token_f1' ELSE 'rouge_l' END AS metric,
       CASE WHEN l_quantity > 45 THEN 1.0 ELSE CAST(CAST(floor(l_quantity) AS INT) % 11 AS DOUBLE) / 10 END AS score,
       l_quantity > 45 AS vacuous,
       l_returnflag <> 'A' AS filled_base, l_linestatus = 'O' AS filled_ext
FROM lineitem
"""

#: Extracted and true records of a run, side by side: names with odd blanks and case, without a name, only on one side;
#: ports missing, with a fraction, in conflict; labels and lists that differ in form or content.
RECORDS = """
SELECT l_orderkey AS run_id, k AS idx, k % 7 <> 0 AS in_ext, k % 7 <> 5 AS in_base,
       CASE WHEN k % 7 = 5 THEN concat('zz zz zz zz 55 ', CAST(l_partkey AS VARCHAR(9))) WHEN k = 6 THEN ''
            ELSE concat(p_name, ' no. ', CAST(k AS VARCHAR(9))) END AS base_name,
       CASE WHEN k % 7 = 5 THEN concat('zz zz zz zz 55 ', CAST(l_partkey AS VARCHAR(9))) WHEN k = 6 THEN CASE WHEN l_suppkey % 2 = 0 THEN NULL ELSE '  ' END
            WHEN l_suppkey % 3 = 0 THEN upper(concat('  ', p_name, '   no. ', CAST(k AS VARCHAR(9)), ' ')) ELSE concat(p_name, ' no. ', CAST(k AS VARCHAR(9))) END AS ext_name,
       CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(l_partkey % 9000 + 1 AS VARCHAR(9)) END AS base_port,
       CASE WHEN l_suppkey % 7 = 0 THEN '9500' WHEN l_suppkey % 7 = 1 THEN NULL WHEN l_suppkey % 7 = 2 THEN concat(CAST(l_partkey % 9000 + 1 AS VARCHAR(9)), '.0')
            WHEN l_suppkey % 7 = 3 THEN ' NaN ' ELSE CAST(l_partkey % 9000 + 1 AS VARCHAR(9)) END AS ext_port,
       CASE WHEN l_partkey % 2 = 0 THEN 'tcp' ELSE 'udp' END AS protocol,
       CASE WHEN l_returnflag = 'A' THEN 'HIGH' WHEN l_returnflag = 'R' THEN 'MEDIUM' ELSE 'LOW' END AS base_severity,
       CASE WHEN l_suppkey % 10 = 0 THEN 'LOW' WHEN l_returnflag = 'A' THEN 'high' WHEN l_returnflag = 'R' THEN 'MEDIUM' ELSE 'LOW' END AS ext_severity,
       p_name AS base_line, p_type AS base_more, CASE WHEN l_suppkey % 11 = 0 THEN '' ELSE concat('was seen: ', p_name, ' ', p_name) END AS ext_line,
       concat('CVE-2020-', CAST(1000 + l_partkey AS VARCHAR(9))) AS base_reference,
       CASE WHEN l_suppkey % 3 = 0 THEN concat('CVE-2020-', CAST(1000 + l_partkey AS VARCHAR(9))) WHEN l_suppkey % 3 = 1 THEN concat('CVE: cve-2020-', CAST(1000 + l_partkey AS VARCHAR(9))) ELSE ' ' END AS ext_reference,
       CAST(l_partkey AS BIGINT) AS base_plugin, CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_partkey AS BIGINT) END AS ext_plugin,
       concat(p_type, ' x') AS ext_family
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_shipdate) AS BIGINT) AS k FROM lineitem JOIN part ON l_partkey = p_partkey) lines
"""

VIEWS = {"records": RECORDS, "findings": FINDINGS, "kev": KEV, "epss": EPSS, "report_lines": REPORT_LINES, "runs": RUNS, "pairs": PAIRS}
TABLES = {"records": ("lineitem", "part"), "findings": ("lineitem", "part"), "kev": ("part",), "epss": ("part",), "report_lines": ("lineitem", "part"), "runs": ("orders",), "pairs": ("lineitem",)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view in Spark."""
    tables = {t: table(spark, sf_dir, t) for t in TABLES[name]}
    if name == "report_lines":
        tables = {"findings": view(spark, sf_dir, "findings")}
    text = VIEWS[name].replace('"precision"', "`precision`").replace("VARCHAR(9)", "STRING").replace("VARCHAR(19)", "STRING")
    for t in tables:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    out = spark.sql(text, **tables)
    if name == "report_lines":
        # A generator keeps the line from being put, as the whole expression, into every filter and column that reads it.
        out = out.select("report_id", "pos", F.explode(F.array("line")).alias("line"))
    return out


def with_views(sql: str, *names: str) -> str:
    """The oracle's SQL with the views that it reads in front."""
    need = [n for n in VIEWS if n in names or n == "findings" and "report_lines" in names]
    more = sql.lstrip().startswith(",") or re.match(r"\s*\w+ AS \(", sql)
    head = "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in need)
    return head + (", " if more else " ") + sql.lstrip().lstrip(",")
