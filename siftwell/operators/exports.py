"""Records as rows and documents of common exchange formats. Array columns: description, solution, impact, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import slug
from siftwell.operators.prioritize import cves, ranked

TOOL, VERSION = "siftwell", "0.1.0"
# Severities in the formats' words.
LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "LOG": "note", "INFO": "note"}
TITLES = {"CRITICAL": "Critical", "HIGH": "High", "MEDIUM": "Medium", "LOW": "Low", "LOG": "Info", "INFO": "Info"}
BASE_SEVERITIES = {"CRITICAL": "CRITICAL", "HIGH": "HIGH", "MEDIUM": "MEDIUM", "LOW": "LOW", "LOG": "NONE", "INFO": "NONE"}
SYSTEM_TYPES = {"OPENVAS": "Network Service", "TENABLEWAS": "Web Application"}
STRICT_CVE = r"(?i)CVE-\d{4}-\d{4,}"


def _mapped(value: Column, table: dict[str, str], default: str | None) -> Column:
    out = F.lit(default).cast("string")
    for k, v in table.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def _lines(c: str) -> Column:
    return F.coalesce(F.array_join(c, "\n"), F.lit(""))


def cve_list(references: Column) -> Column:
    return cves(F.array_join(references, "\n"), STRICT_CVE)


def endpoint(host: Column, port: Column) -> Column:
    return F.when(F.coalesce(host, F.lit("")) == "", None).when(port.isNotNull() & (port != "general"), F.concat(host, F.lit(":"), port)).otherwise(host)


def rule_id(source: Column, plugin: Column, name: Column) -> Column:
    return F.concat(source, F.lit("-"), F.when(F.coalesce(plugin, F.lit(0)) != 0, plugin.cast("string")).otherwise(slug(name)))


def _plugin(records: DataFrame) -> Column:
    return F.col("plugin") if "plugin" in records.columns else F.lit(None).cast("long")


def _score(records: DataFrame) -> Column:
    return F.col("cvss_score") if "cvss_score" in records.columns else F.lit(None).cast("double")


def _score_lines(records: DataFrame) -> Column:
    return F.array_join("cvss_lines", " ") if "cvss_lines" in records.columns else F.lit("")


def findings_rows(records: DataFrame) -> DataFrame:
    """seq and the columns of a generic findings import; keys that are null are left out of its JSON."""
    ids = cve_list(F.col("references"))
    text = lambda c: F.coalesce(F.col(c), F.lit("None"))
    return records.select(
        "seq", F.col("name").alias("title"), _mapped(F.col("severity"), TITLES, "Info").alias("severity"), _lines("description").alias("description"), _lines("solution").alias("mitigation"), _lines("impact").alias("impact"), _lines("references").alias("references"),
        F.lit(True).alias("active"), F.lit(True).alias("dynamic_finding"), F.lit(False).alias("static_finding"), F.coalesce(F.nullif(_plugin(records), F.lit(0)).cast("string"), "name").alias("vuln_id_from_tool"),
        F.concat_ws("|", text("source"), text("name"), text("host"), text("port")).alias("unique_id_from_tool"), F.try_element_at(ids, F.lit(1)).alias("cve"),
        F.when(F.size(ids) > 0, F.transform(ids, lambda c: F.struct(c.alias("vulnerability_id")))).alias("vulnerability_ids"), _score(records).alias("cvssv3_score"),
        F.when(endpoint(F.col("host"), F.col("port")).isNotNull(), F.array(endpoint(F.col("host"), F.col("port")))).alias("endpoints"),
    )


def sarif_rules(records: DataFrame) -> DataFrame:
    """rule_id, rule_index (from 0, by first appearance), name and help of the first record of each rule."""
    keyed = records.select(rule_id(F.col("source"), _plugin(records), F.col("name")).alias("rule_id"), "seq", "name", F.nullif(_lines("solution"), F.lit("")).alias("help"))
    first = keyed.groupBy("rule_id").agg(F.min(F.struct("seq", "name", "help")).alias("f")).select("rule_id", F.col("f.seq").alias("first_seq"), "f.name", "f.help")
    return ranked(first, [F.col("first_seq"), F.col("rule_id")], "rule_index").withColumn("rule_index", F.col("rule_index") - 1).drop("first_seq")


def sarif_results(records: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """seq, rule_id, rule_index, level, message, location and the property bag as JSON with its nulls."""
    rows = records.withColumn("rule_id", rule_id(F.col("source"), _plugin(records), F.col("name"))).join((rules or sarif_rules(records)).select("rule_id", "rule_index"), "rule_id")
    place = F.when(F.coalesce("host", F.lit("")) != "", F.concat_ws(":", "host", "port"))
    bag = F.to_json(F.struct("severity", _score(records).alias("cvss"), "source", "port", "protocol"), {"ignoreNullFields": "false"})
    return rows.select("seq", "rule_id", "rule_index", _mapped(F.col("severity"), LEVELS, "note").alias("level"), F.coalesce(F.nullif(_lines("description"), F.lit("")), "name").alias("message"), place.alias("location"), bag.alias("properties"))


def hosts(records: DataFrame) -> DataFrame:
    """host and product_id by first appearance."""
    first = records.where(F.coalesce("host", F.lit("")) != "").groupBy("host").agg(F.min("seq").alias("first_seq"))
    return ranked(first, [F.col("first_seq"), F.col("host")], "place").select("host", F.concat(F.lit("HOST-"), F.col("place").cast("string")).alias("product_id"))


def advisories(records: DataFrame) -> DataFrame:
    """seq and the parts of a CSAF vulnerability; scores need both a v3 vector and a v3 base score."""
    lines = _score_lines(records)
    vector, score = F.nullif(F.regexp_extract(lines, r"(?i)CVSSV3\s+VECTOR\s+(CVSS:3[^\s]+)", 1), F.lit("")), F.nullif(F.regexp_extract(lines, r"(?i)CVSSV3\s+BASE\s+SCORE\s+([\d.]+)", 1), F.lit(""))
    both = vector.isNotNull() & score.isNotNull()
    rows = records.join(hosts(records), "host", "left")
    return rows.select(
        "seq", F.col("name").alias("title"), F.coalesce(F.nullif(_lines("description"), F.lit("")), "name").alias("note"), F.try_element_at(cve_list(F.col("references")), F.lit(1)).alias("cve"), "product_id", F.nullif(_lines("solution"), F.lit("")).alias("mitigation"),
        F.when(both, F.when(F.startswith(vector, F.lit("CVSS:3.1")), "3.1").otherwise("3.0")).alias("cvss_version"), F.when(both, vector).alias("vector_string"), F.when(both, score.try_cast("double")).alias("base_score"),
        F.when(both, _mapped(F.col("severity"), BASE_SEVERITIES, "NONE")).alias("base_severity"),
    )


def institutional(records: DataFrame) -> DataFrame:
    """The 39 keys of the institutional row format, in dotted column names, with seq."""
    host, lines = F.col("host"), _score_lines(records)
    is_ip = F.coalesce(F.regexp_like("host", F.lit(r"^(?:\d{1,3}\.){3}\d{1,3}$")), F.lit(False))
    ids = F.nullif(F.array_join(cve_list(F.col("references")), ", "), F.lit(""))
    cwes = F.array_distinct(F.transform(F.regexp_extract_all(F.array_join("references", "\n"), F.lit(r"(?i)CWE[-\s](\d+)"), F.lit(1)), lambda n: F.concat(F.lit("CWE-"), n)))
    number = lambda p: F.nullif(F.regexp_extract(lines, p, 1), F.lit(""))
    details = lambda k: F.col(f"plugin_details.{k}") if "plugin_details" in records.columns else None
    known: dict[str, Column] = {
        "id": F.concat(F.lit("vuln_"), F.col("seq").cast("string")), "asset.name": host, "asset.display_fqdn": F.when(~is_ip, host), "asset.display_ipv4_address": F.when(is_ip, host), "asset.host_name": host, "asset.operating_system": None,
        "asset.system_type": _mapped(F.col("source"), SYSTEM_TYPES, None), "definition.name": F.col("name"), "definition.severity": F.col("severity"), "definition.description": F.nullif(_lines("description"), F.lit("")), "definition.solution": F.nullif(_lines("solution"), F.lit("")),
        "definition.id": F.nullif(_plugin(records), F.lit(0)).cast("string"), "definition.family": details("family"), "definition.type": None, "definition.cve": ids, "definition.cwe": F.nullif(F.array_join(cwes, ", "), F.lit("")), "definition.cpe": None, "definition.references": F.array_join("references", "; "), "definition.see_also": F.lit(""),
        "definition.cvss3.base_score": F.coalesce(_score(records), number(r"(?i)CVSSV3\s+BASE\s+SCORE\s+([\d.]+)").try_cast("double")), "definition.cvss3.base_vector": number(r"(?i)CVSSV3\s+VECTOR\s+(\S+)"),
        "definition.cvss2.base_score": number(r"(?i)CVSS\s+BASE\s+SCORE\s+([\d.]+)").try_cast("double"), "definition.cvss2.base_vector": number(r"(?i)CVSS\s+VECTOR\s+(\S+)"), "definition.synopsis": None, "definition.plugin_published": details("publication_date"), "definition.vulnerability_published": None, "definition.patch_published": None,
        "definition.epss.score": None, "definition.exploitability_ease": None, "output": F.nullif(_lines("detection_result"), F.lit("")) if "detection_result" in records.columns else None, "port": F.col("port"), "protocol": F.col("protocol"), "scan.id": None, "scan.target": host,
        "severity": F.col("severity"), "state": F.lit("open"), "first_observed": None, "last_seen": None, "age_in_days": None,
    }
    return records.select("seq", *[(F.lit(None).cast("string") if c is None else c).alias(k) for k, c in known.items()])


def flat_cells(records: DataFrame) -> DataFrame:
    """Lists of texts joined by line breaks, other nested values as JSON, for tabular files."""

    def cell(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind == "array<string>":
            return F.array_join(c, "\n").alias(name)
        return F.to_json(c).alias(name) if kind.startswith(("array", "struct", "map")) else c

    return records.select(*[cell(n, k) for n, k in records.dtypes])


def sarif_document(records: DataFrame) -> DataFrame:
    """One row: the SARIF document as JSON. It gathers all rows of an export, so it is for one report's records."""
    rules = sarif_rules(records)
    driver = rules.agg(F.transform(F.array_sort(F.collect_list(F.struct("rule_index", "rule_id", "name", "help"))), lambda r: F.struct(r["rule_id"].alias("id"), r["name"].alias("name"), F.struct(r["name"].alias("text")).alias("shortDescription"), F.when(r["help"].isNotNull(), F.struct(r["help"].alias("text"))).alias("help"))).alias("rules"))
    result = lambda r: F.struct(
        r["rule_id"].alias("ruleId"), r["rule_index"].alias("ruleIndex"), r["level"].alias("level"), F.struct(r["message"].alias("text")).alias("message"), r["properties"].alias("properties"),
        F.when(r["location"].isNotNull(), F.array(F.struct(F.array(F.struct(r["location"].alias("fullyQualifiedName"), F.lit("resource").alias("kind"))).alias("logicalLocations")))).alias("locations"))
    results = sarif_results(records, rules).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "rule_id", "rule_index", "level", "message", "location", "properties"))), result).alias("results"))
    run = F.struct(F.struct(F.struct(F.lit(TOOL).alias("name"), F.lit(VERSION).alias("version"), F.col("rules")).alias("driver")).alias("tool"), F.col("results"))
    return driver.join(results).select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("document"))  # one row each


def _one_row(rows: DataFrame, row: Column, name: str) -> DataFrame:
    """All rows in order of seq as one array; for one report's records."""
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("seq"), row.alias("row")))), lambda x: x["row"]).alias(name))


def generic_document(records: DataFrame) -> DataFrame:
    """One row: the generic findings document as JSON, keys that are null left out."""
    rows = findings_rows(records)
    return _one_row(rows, F.to_json(F.struct(*[c for c in rows.columns if c != "seq"])), "findings").select(F.concat(F.lit('{"findings":['), F.array_join("findings", ","), F.lit("]}")).alias("document"))


def csaf_document(records: DataFrame, now: str, title: str = "Findings") -> DataFrame:
    """One row: the CSAF 2.0 document as JSON. now: the time of the release, in ISO form, which also names the document."""
    rows = advisories(records)
    product = F.when(F.col("product_id").isNotNull(), F.array("product_id"))
    note = F.struct(F.lit("description").alias("category"), F.col("note").alias("text"))
    score = F.struct(F.col("cvss_version").alias("version"), F.col("vector_string").alias("vectorString"), F.col("base_score").alias("baseScore"), F.col("base_severity").alias("baseSeverity"))
    fix = F.struct(F.lit("mitigation").alias("category"), F.col("mitigation").alias("details"), product.alias("product_ids"))
    one = F.struct(
        "title", F.array(note).alias("notes"), "cve", F.when(product.isNotNull(), F.struct(product.alias("known_affected"))).alias("product_status"),
        F.when(F.col("base_score").isNotNull() & product.isNotNull(), F.array(F.struct(product.alias("products"), score.alias("cvss_v3")))).alias("scores"), F.when(F.col("mitigation").isNotNull(), F.array(fix)).alias("remediations"),
    )
    found = _one_row(rows, F.to_json(one), "vulnerabilities")
    known = hosts(records).withColumn("seq", F.regexp_extract("product_id", r"(\d+)$", 1).cast("long"))
    products = _one_row(known, F.to_json(F.struct(F.col("host").alias("name"), "product_id")), "products")
    revision = F.struct(F.lit(now).alias("date"), F.lit("1").alias("number"), F.lit("Initial release").alias("summary"))
    tracking = F.struct(F.lit(f"{TOOL}-{now}").alias("id"), F.lit(now).alias("initial_release_date"), F.lit(now).alias("current_release_date"), F.lit("1").alias("version"), F.lit("final").alias("status"), F.array(revision).alias("revision_history"))
    publisher = F.struct(F.lit("vendor").alias("category"), F.lit(TOOL).alias("name"), F.lit("https://example.com").alias("namespace"))
    head = F.to_json(F.struct(F.lit("csaf_security_advisory").alias("category"), F.lit("2.0").alias("csaf_version"), F.lit(title).alias("title"), publisher.alias("publisher"), tracking.alias("tracking")))
    text = F.concat(F.lit('{"document":'), head, F.lit(',"product_tree":{"full_product_names":['), F.array_join("products", ","), F.lit(']},"vulnerabilities":['), F.array_join("vulnerabilities", ","), F.lit("]}"))
    return found.join(products).select(text.alias("document"))  # one row each


EXPORTERS = {"generic": findings_rows, "sarif": sarif_results, "csaf": advisories, "cais": institutional, "csv": flat_cells}


def exporter(name: str):
    """An exporter by its name in any case."""
    if name.lower() not in EXPORTERS:
        raise ValueError(f"no exporter {name!r}; there are {', '.join(sorted(EXPORTERS))}")
    return EXPORTERS[name.lower()]


def register(name: str, function) -> None:
    EXPORTERS[name.lower()] = function
