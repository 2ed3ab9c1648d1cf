"""Operators of the engine against known values and plain definitions."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from siftwell.functions import similarity, text
from siftwell.operators import align, consolidate, evaluate, exports, pack, prioritize, reconcile, segment
from siftwell.sources import readers, writers


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expression.alias("x")).first().x


NETWORK = """preamble
10.0.0.5
Host scan start today
2.1 High 443/tcp
High (CVSS: 9.8)
NVT: first
2 RESULTS PER HOST 7
Summary
High (CVSS: 7.5)
NVT: second
2.2 Low 25/tcp
Low (CVSS: 2.0)
NVT: third"""

WEB = """intro
First finding
VULNERABILITY HIGH PLUGIN ID 10
Description
text
See Also
https://x.example
First finding Instances
(1)
VULNERABILITY HIGH PLUGIN ID 10
INSTANCE a"""


def blocks(spark, content, layout):
    df = spark.createDataFrame([("r", content)], "report_id string, text string")
    return sorted(segment.segment(segment.lines(df), layout).collect(), key=lambda r: r.block_id)


def test_network_segments(spark):
    got = blocks(spark, NETWORK, segment.NETWORK)
    assert [(b.severity_hint, b.host, b.port, b.protocol) for b in got] == [("HIGH", "10.0.0.5", "443", "tcp"), ("HIGH", "10.0.0.5", "443", "tcp"), ("LOW", "10.0.0.5", "25", "tcp")]
    assert "RESULTS" not in got[0].text and "preamble" not in got[0].text and got[0].text.startswith("High (CVSS: 9.8)\nNVT: first")


def test_web_segments_take_the_name_above(spark):
    got = blocks(spark, WEB, segment.WEB)
    assert [b.text.split("\n")[0] for b in got] == ["First finding", "First finding Instances"]
    assert got[0].text.endswith("https://x.example") and got[1].text.startswith("First finding Instances\n(1)\nVULNERABILITY")


def test_reports_without_blocks(spark):
    df = spark.createDataFrame([("a", "nothing"), ("b", NETWORK)], "report_id string, text string")
    assert [r.report_id for r in segment.unsegmented(df, segment.segment(segment.lines(df), segment.NETWORK)).collect()] == ["a"]


def test_layout_from_json():
    got = segment.load_layout(json.dumps({"name": "x", "marker_pattern": "^FINDING (HIGH|LOW)", "context": {"header_patterns": [r"^(?P<sev>High) (?P<port>\d+)/(?P<proto>\w+)"]}}))
    assert got.headers == ((r"^(High) (\d+)/(\w+)", 2, 3),) and got.source == "X"


def chunks(spark, sizes, max_blocks, budget):
    df = spark.createDataFrame([("r", k, "x" * n) for k, n in enumerate(sizes)], "report_id string, block_id int, text string")
    return [(list(r.block_ids), r.oversized) for r in sorted(pack.pack(df, max_blocks, budget).collect(), key=lambda r: r.chunk)]


def test_packing(spark):
    assert [len(c) for c, _ in chunks(spark, [10] * 10, 3, 5000)] == [3, 3, 3, 1]
    assert [len(c) for c, _ in chunks(spark, [10] * 11, 4, 5000)] == [4, 4, 3]
    assert chunks(spark, [40_000, 10], 4, 1000) == [([0], True), ([1], False)]
    assert chunks(spark, [10, 40_000, 10], 4, 1000) == [([0], False), ([1], False), ([2], False)]
    assert [pack.retry_limit(4, k) for k in range(4)] == [4, 2, 1, 1]


def test_rendering_and_truncation(spark):
    df = spark.createDataFrame([("10.0.0.1", "443", "tcp", 3, "body"), (None, "1", None, 4, "b")], "host string, port string, protocol string, block_id int, text string")
    got = [r.x for r in df.select(pack.rendered(*[F.col(c) for c in ("host", "port", "protocol", "block_id", "text")]).alias("x")).collect()]
    assert got == ["### BLOCK 3 (host: 10.0.0.1, port: 443/tcp)\nbody", "### BLOCK 4\nb"]
    cut = one(spark, pack.truncated(F.col("t"), 100), t="line\n" * 200)
    assert cut.startswith("line\n") and cut.split("\n")[-1].startswith("[TRUNCATED") and len(cut) < 450


ITEM, KEYS = "name string, port string, protocol string", ["block_id", "name", "port", "protocol"]


def test_answers(spark):
    rows = [("r", 0, '[{"block_id": 0, "name": "a"}]'), ("r", 1, '```json\n{"block_id": 1, "name": "b"}\n```'), ("r", 2, "no json"), ("r", 3, '{"items": [{"block_id": 3, "extra": 1}]}'), ("r", 4, '<think>x</think>{"items": [{"block_id": 4, "name": "d"}]}')]
    got = reconcile.parsed(spark.createDataFrame(rows, "report_id string, chunk int, raw string"), ITEM, KEYS).collect()
    assert {(r.chunk, r.valid, r.block_id) for r in got} == {(0, True, 0), (1, True, 1), (2, False, None), (3, False, None), (4, True, 4)}


def test_extraction_retries_until_all_is_bound(spark):
    df = spark.createDataFrame([("r", k, f"text {k}", None, None, None) for k in range(8)], "report_id string, block_id int, text string, host string, port string, protocol string")
    asked = []

    def extractor(chunk_texts):
        asked.append(chunk_texts.count())
        found = F.regexp_extract_all("text", F.lit(r"### BLOCK (\d+)"), F.lit(1))
        items = F.concat(F.lit('{"items":['), F.array_join(F.transform(found, lambda b: F.concat(F.lit('{"block_id":'), b, F.lit(',"name":"n"}'))), ","), F.lit("]}"))
        return chunk_texts.select("report_id", "chunk", F.when((F.size(found) > 2) & F.array_contains(found, "1"), F.lit("broken")).otherwise(items).alias("raw"))

    bound, left = reconcile.extract(df, extractor, ITEM, KEYS, 4, 5000)
    assert asked == [2, 2] and {r.block_id for r in bound.collect()} == set(range(8)) and left.count() == 0


def test_backfill(spark):
    b = spark.createDataFrame([("r", 0, "h", "443", "tcp"), ("r", 1, "h", "general", "cpe-t"), ("r", 2, "h", "9", "udp")], "report_id string, block_id int, host string, port string, protocol string")
    bound = spark.createDataFrame([("r", 0, "a", None, None), ("r", 1, "b", None, None), ("r", 2, "c", "80", None)], "report_id string, block_id int, name string, port string, protocol string")
    got = {r.name: (r.host, r.port, r.protocol, r.source) for r in reconcile.backfilled(bound, b, "S").collect()}
    assert got == {"a": ("h", "443", "tcp", "S"), "b": ("h", "general", None, "S"), "c": ("h", "80", None, "S")}


RECORDS = "report_id string, seq int, name string, plugin int, instances array<string>, solution array<string>, cvss double"


def test_pairing_fold(spark):
    rows = [("r", 1, "Flaw", 7, [], ["fix"], None), ("r", 2, "flaw  Instances (2)", 7, ["u1", "u2"], [], 0.0), ("r", 3, "Flaw", 8, [], [], None)]
    got = {r.seq: r for r in consolidate.paired(spark.createDataFrame(rows, RECORDS), ["plugin"]).collect()}
    assert got[1].name == "Flaw" and got[1].instances == ["u1", "u2"] and got[1].solution == ["fix"] and got[1].cvss == 0.0 and got[1].merged == 2 and got[3].merged == 1
    assert consolidate.merge_log(consolidate.paired(spark.createDataFrame(rows, RECORDS), ["plugin"])).count() == 1


def test_exact_repeats(spark):
    rows = [("r", 1, "A  flaw", 7, [], [], None), ("r", 2, "a flaw ", 7, [], [], None), ("r", 3, "A flaw", 7, [], ["x"], None), ("q", 4, "A flaw", 7, [], [], None)]
    got = {(r.seq, r.repeats) for r in consolidate.without_repeats(spark.createDataFrame(rows, RECORDS)).collect()}
    assert got == {(1, 2), (3, 1), (4, 1)}


@pytest.mark.parametrize("host, expected", [("10.0.0.5", "internal"), ("127.0.0.1", "internal"), ("srv01", "internal"), ("app.corp", "internal"), ("example.com", "exposed"), (None, "exposed"), ("https://www.example.com:8443/x?y", "exposed"), ("100.64.0.1", "exposed"), ("192.0.0.9", "exposed"), ("240.1.1.1", "internal"), ("::1", "internal"), ("2001:4860::1", "exposed"), ("[::1]:443", "internal"), ("HTTP://10.1.2.3:80/a", "internal")])
def test_exposure(spark, host, expected):
    assert one(spark, prioritize.exposure(F.col("h")), h=host) == expected


def test_queue(spark):
    rows = [(1, "low", "10.0.0.1", "LOW", 2.0, "none"), (2, "web", "example.com", "HIGH", 9.8, "cve-2020-1"), (3, "mid", "example.com", "MEDIUM", None, "CVE-2020-2 CVE-2020-2")]
    findings = spark.createDataFrame(rows, "seq int, name string, host string, severity string, cvss double, reference string")
    got = prioritize.queue(findings, spark.createDataFrame([("CVE-2020-1",)], "cve string"), spark.createDataFrame([("CVE-2020-2", 0.5)], "cve string, epss double"), "2026-01-01").orderBy("rank").collect()
    assert [(r.rank, r.name, r.category, r.exploitation) for r in got] == [(1, "web", "Act", "active"), (2, "mid", "Attend", "likely"), (3, "low", "Track", "unknown")]
    assert got[1].cves == "CVE-2020-2" and got[2].justification == "no CVE to assess exploitation; internal asset; low severity"


def test_scores(spark):
    assert one(spark, similarity.set_f1(F.split("a", ","), F.split("b", ",")), a="1,2", b="2,3,4") == pytest.approx(0.4)
    assert one(spark, similarity.token_f1(F.col("a"), F.col("b")), a="a b c", b="a b d e") == pytest.approx(4 / 7)
    assert one(spark, similarity.rouge_l("a", "b"), a="a b c d", b="a x c d") == pytest.approx(0.75)
    assert one(spark, similarity.exact(F.col("a"), F.col("b")), a="8019", b="8019.0") == 1 and one(spark, similarity.exact(F.col("a"), F.col("b")), a="Tcp ", b="tcp") == 1
    for other in ("CVE 2020-1234", "cve: 2020 1234", "CVE-2020-1234"):
        assert one(spark, similarity.set_f1_ids(F.col("a"), F.col("b")), a="cve-2020-1234", b=other) == 1
    for a, b in [("BID:32668, 32669", "bid 32669\nBID 32668"), ("https://x.example/a/", "see https://x.example/a"), ("2021-A1", "OWASP 2021-a1"), ("WASC Cross Site, Buffer", "wasc buffer\nWASC cross site")]:
        assert one(spark, similarity.set_f1_ids(F.col("a"), F.col("b")), a=a, b=b) == 1, a
    df = spark.createDataFrame([("", " "), ("x", ""), ("x", "x")], "a string, b string")
    score, vacuous = similarity.pair_score(F.lit(0.5), F.col("a"), F.col("b"))
    assert [(r.s, r.v) for r in df.select(score.alias("s"), vacuous.alias("v")).collect()] == [(1.0, True), (0.0, False), (0.5, False)]


def test_subsequence_against_the_table():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 80))) for _ in range(2))
        assert similarity.lcs(a, b) == slow(a, b)


def test_assignment_is_best():
    rng = random.Random(4)
    for _ in range(100):
        n, m = rng.randint(1, 4), rng.randint(4, 6)
        cost = [[rng.random() for _ in range(m)] for _ in range(n)]
        got = sum(cost[i][j] for i, j in align.best_assignment(cost))
        assert got == pytest.approx(min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(m), n)))


def sides(spark, ext, base):
    schema = "run_id string, idx long, name string, port string, protocol string"
    return [align.keyed(spark.createDataFrame([("r", k, *x) for k, x in enumerate(rows)], schema), ("port", "protocol")) for rows in (ext, base)]


def test_alignment(spark):
    e, b = sides(spark, [("Open port", "443", "tcp"), ("Ghost Finding", "1", "tcp"), ("Weak cipher", None, "tcp"), ("open port", "443", "tcp")], [("Weak cipher", "8019.0", "tcp"), ("Open port", "443", "tcp"), ("Missed thing entirely", "5", "udp")])
    pairs = align.assign(e, b)
    assert {(r.ext_idx, r.base_idx, r.similarity) for r in pairs.collect()} == {(0, 1, 1.0), (2, 0, 1.0)}
    false, missed = align.unmatched(e, b, pairs)
    assert {r.idx for r in missed.collect()} == {2}
    assert {r.idx: r.kind for r in align.false_positive_kinds(false, e, b, pairs).collect()} == {1: "invention", 3: "duplicate"}
    similar = {(r.ext_idx, r.base_idx): r.similarity for r in align.pair_similarity(e, b).collect()}
    assert similar[(0, 1)] == 1.0 and all(v >= 0 for v in similar.values())


def test_key_parts(spark):
    df = spark.createDataFrame([("8019.0",), ("8,019",), ("general",), ("nan",), (None,), ("web",)], "p string")
    assert [r.x for r in df.select(align.key_part(F.col("p"), True).alias("x")).collect()] == ["8019", "8019", "general", "*", "*", "*"]


def test_summary(spark):
    rows = [("f", "m", 1.0, True, False, False), ("f", "m", 0.5, False, True, True), ("f", "m", 0.7, False, True, False), ("g", "n", 1.0, True, False, False)]
    df = spark.createDataFrame(rows, "field string, metric string, score double, vacuous boolean, filled_base boolean, filled_ext boolean")
    got = {r.field: r for r in evaluate.field_summary(df).collect()}
    assert (got["f"].measured_mean, got["f"].n_measured, got["f"].vacuous_n, got["f"].fill_base) == (0.6, 2, 1, 0.6667) and got["g"].measured_mean is None
    pivot = {r.field: (r.m, r.n) for r in evaluate.summary_pivot(evaluate.field_summary(df), ["m", "n"]).collect()}
    assert pivot == {"f": ("0.600", "-"), "g": ("-", "n/a")}
    assert [r.field for r in evaluate.never_filled(evaluate.field_summary(df)).collect()] == ["g"]
    assert writers.markdown(evaluate.summary_pivot(evaluate.field_summary(df), ["m", "n"]), ["m", "n"]).endswith("| g | - | n/a |")


def test_exclusive_quartiles(spark):
    import statistics

    rng = random.Random(5)
    for values in ([1, 2, 3, 4, 5, 7], [1, 2], [3], [rng.random() for _ in range(17)]):
        df = spark.createDataFrame([("a", float(v)) for v in values], "k string, v double")
        r = evaluate.boxes(df, "v", "k").first()
        q = statistics.quantiles(values, n=4) if len(values) > 1 else [values[0]] * 3
        assert (r.q1, r.med, r.q3) == pytest.approx([round(x, 4) for x in q])


def test_exports(spark):
    schema = "seq long, name string, description array<string>, solution array<string>, impact array<string>, references array<string>, severity string, host string, port string, protocol string, source string, plugin long, cvss_lines array<string>"
    rows = [(1, "A flaw!", ["d1", "d2"], ["s"], [], ["CVE-2020-12345 CWE-79", "cve-2020-12345"], "HIGH", "10.0.0.1", "443", "tcp", "TENABLEWAS", None, ["CVSSV3 BASE SCORE 9.8", "CVSSV3 VECTOR CVSS:3.1/AV:N"]), (2, "A flaw!", [], [], [], [], "INFO", "x.example", "general", None, "OPENVAS", 9, [])]
    df = spark.createDataFrame(rows, schema)
    g = {r.seq: r for r in exports.exporter("GENERIC")(df).collect()}
    assert g[1].cve == "CVE-2020-12345" and len(g[1].vulnerability_ids) == 1 and g[1].endpoints == ["10.0.0.1:443"] and g[2].endpoints == ["x.example"] and g[2].vuln_id_from_tool == "9" and g[2].severity == "Info"
    s = {r.seq: r for r in exports.sarif_results(df).collect()}
    assert (s[1].rule_id, s[1].rule_index, s[1].level, s[1].message) == ("TENABLEWAS-A-flaw", 0, "error", "d1\nd2") and (s[2].rule_id, s[2].rule_index, s[2].location) == ("OPENVAS-9", 1, "x.example:general")
    assert json.loads(s[2].properties)["protocol"] is None
    c = {r.seq: r for r in exports.advisories(df).collect()}
    assert (c[1].product_id, c[1].cvss_version, c[1].base_score, c[1].base_severity) == ("HOST-1", "3.1", 9.8, "HIGH") and c[2].vector_string is None and c[2].product_id == "HOST-2"
    i = {r.seq: r.asDict() for r in exports.institutional(df).collect()}
    assert len(i[1]) == 40 and i[1]["definition.cwe"] == "CWE-79" and i[1]["asset.display_ipv4_address"] == "10.0.0.1" and i[2]["asset.display_fqdn"] == "x.example" and i[2]["definition.id"] == "9"
    document = json.loads(exports.sarif_document(df).first().document)
    assert document["version"] == "2.1.0" and len(document["runs"][0]["results"]) == 2
    with pytest.raises(ValueError):
        exports.exporter("nope")


def test_cleaning(spark):
    assert one(spark, text.clean_page(F.col("t")), t="a\tb   c\nPage 1 of 3\nx continued on next page\nend  \n\n") == "a b c\nend\n"
    assert one(spark, text.clean_text(F.col("t")), t="o\x1bice exam-\n ple\x07 (cid:28)x(cid:99) wra\n  (cid:44)→pped\r") == "office example fix wrapped"
    assert one(spark, text.clean_page(F.col("t")), t="a ÔåÆ b\n . . . continues on next page ...") == "a -> b\n"
    assert one(spark, text.normal_name(F.col("t")), t="  A  b\n") == "a b" and one(spark, text.slug(F.col("t")), t="--A b!c--") == "A-b-c"
    assert one(spark, similarity.nfkc("t"), t="ﬁ") == "fi"


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "openvas").mkdir()
    (tmp_path / "openvas" / "one.txt").write_text("first\tpage\fPage 2 of 2\nsecond")
    reports = readers.report_files(spark, f"file://{tmp_path}/openvas").withColumn("scanner", readers.scanner_of(F.col("report_id"), ["openvas"]))
    r = reports.first()
    assert (r.stem, r.scanner, r.page_count) == ("one", "openvas", 2) and r.text == "first page\nsecond\n" and readers.empty_reports(reports).count() == 0
    (tmp_path / "kev.json").write_text('{"vulnerabilities": [{"cveID": "cve-1"}, {"cveID": "CVE-1"}]}')
    (tmp_path / "epss.csv").write_text("#model,score_date:2026-01-02T00:00\ncve,epss,percentile\ncve-1,0.1,0.2\nCVE-1,0.3,0.4\n")
    assert [x.cve for x in readers.kev(spark, f"file://{tmp_path}/kev.json").collect()] == ["CVE-1"]
    assert [(x.cve, x.epss) for x in readers.epss(spark, f"file://{tmp_path}/epss.csv").collect()] == [("CVE-1", 0.3)]
    assert readers.score_date(spark, f"file://{tmp_path}/epss.csv").first().score_date == "2026-01-02T00:00"
    (tmp_path / "float.csv").write_text('scan,"x"\n\nIP,DNS,QID\n1.1.1.1,a,7\n')
    assert [x.row["QID"] for x in readers.floating_header_export(spark, f"file://{tmp_path}/float.csv").collect()] == ["7"]
    writers.json_array(spark.createDataFrame([(2, "b", None), (1, "a", ["x"])], "seq int, name string, refs array<string>"), f"file://{tmp_path}/out")
    assert json.loads(spark.read.text(f"file://{tmp_path}/out", wholetext=True).first().value) == [{"name": "a", "refs": ["x"]}, {"name": "b", "refs": None}]


def test_streamed_reports(spark, tmp_path):
    from siftwell.streaming.reports import blocks_of_new_reports

    spark.createDataFrame([("r", NETWORK)], "report_id string, text string").write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        blocks_of_new_reports(spark, f"{tmp_path}/in", segment.NETWORK, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_entry_imports_without_the_subpackage():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"prioritize_queue", "segment_blocks"} <= names and set(__spark_entry__.oracle_sql()) <= names


def test_rules_for_network_blocks(spark):
    from siftwell.operators import rules

    body = "High (CVSS: 9.8)\nNVT: Old\nserver\n\nSummary\nis old\nReferences\nCVE: CVE-2008-5304, CVE-2008-5305\nBID:32668, 32669\nOther:\nSolution:\nupdate"
    df = spark.createDataFrame([("r", 0, body, "443", "tcp"), ("r", 1, "Log (CVSS: 0.0)\nNVT: x\nSummary\nsee 80/tcp", None, None)], "report_id string, block_id int, text string, port string, protocol string")
    a, b = sorted(rules.network_fields(df).collect(), key=lambda r: r.block_id)
    assert (a.name, a.severity, a.cvss, a.port, a.description, a.solution) == ("Old server", "HIGH", 9.8, "443", ["is old"], ["update"])
    assert a.references == ["CVE-2008-5304", "CVE-2008-5305", "BID:32668", "BID:32669"]
    assert (b.severity, b.cvss, b.port, b.protocol, b.impact) == ("LOG", 0.0, "80", "tcp", [])


def test_instances_of_web_blocks(spark):
    from siftwell.operators import rules

    body = "VULNERABILITY HIGH PLUGIN ID 10\nINSTANCE\nhttps://x/a\nINPUT TYPE form\nINPUT NAME q\nPAYLOAD\n<x>\nPROOF\none\ntwo\nOUTPUT\n-\nREQUEST MADE\nGET /a HTTP/1.1\nRESPONSE HEADERS\nHTTP/1.1 200 OK\ncontent-type: text/html; charset=x\nINSTANCE\nhttps://x/b"
    df = spark.createDataFrame([("r", 0, body)], "report_id string, block_id int, text string")
    a, b = sorted(rules.instances(df).collect(), key=lambda r: r.instance_no)
    assert (a.instance, a.input_type, a.input_name, a.payload, a.proof, a.output) == ("https://x/a", "form", "q", "<x>", "one two", "")
    assert (a.request_method, a.http_protocol, a.http_status_code, a.response_content_type) == ("GET", "HTTP/1.1", 200, "text/html") and b.instance == "https://x/b"
    base = spark.createDataFrame([(10, "n"), (11, "m")], "plugin long, name string")
    assert {r.plugin: len(r.instances) for r in rules.annotated(base, df).collect()} == {10: 2, 11: 0}


def test_common_lengths_of_many_names():
    rng = random.Random(5)
    names = ["", "a", "abc" * 40] + ["".join(rng.choice("abcé ") for _ in range(rng.randint(0, 70))) for _ in range(40)]
    got = align.common_lengths(names, names[::-1])
    assert [[int(x) for x in row] for row in got] == [[similarity.lcs(a, b) for b in names[::-1]] for a in names]


def test_assignment_query_takes_every_finding(spark, tmp_path):
    """Suppliers and ids of any remainder take part, and the pairs are the best of all permutations."""
    import datetime

    from siftwell import queries

    rng = random.Random(7)
    parts = [(k, rng.choice(["open port", "weak cipher", "old server"]) + f" {k}", rng.choice(["SMALL TIN", "LARGE TIN"])) for k in range(1, 30)]
    rows = [(order, rng.randint(1, 29), supplier, line, 5.0, "A", datetime.date(1995, 1, 1), 1.0, 0.0) for supplier in (3, 10, 14) for order, line in ((2, 1), (4, 2), (6, 3), (8, 1), (3, 1), (5, 2), (7, 3), (9, 1), (11, 2))]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_shipdate date, l_extendedprice double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    e, b = (df.collect() for df in queries._sides(spark, str(tmp_path)))
    got = queries.align_assignment(spark, str(tmp_path)).collect()

    def score(x, y):
        if x.norm_name == y.norm_name:
            return 1.0 if all(p == "*" or q == "*" or p == q for p, q in zip(x.parts, y.parts)) else 0.9
        return 0.9 * 2 * similarity.lcs(x.norm_name, y.norm_name) / (len(x.norm_name) + len(y.norm_name))

    for supplier in (3, 10, 14):
        x, y = ([r for r in side if r.run_id == supplier] for side in (e, b))
        assert len(x) == 4 and len(y) == 5
        chosen = max(itertools.permutations(range(5), 4), key=lambda p: sum(score(x[i], y[j]) for i, j in enumerate(p)))
        best = sorted(s for s in (score(x[i], y[j]) for i, j in enumerate(chosen)) if s >= align.THRESHOLD)
        assert sorted(r.similarity for r in got if r.run_id == supplier) == pytest.approx(best)


def test_scores_of_whole_texts(spark, tmp_path):
    """Texts that agree in their first 400 characters only; scores follow all of them."""
    import re
    from collections import Counter

    from siftwell import queries

    rng = random.Random(2)
    head = "same words here " * 30
    texts = [head + " ".join(rng.choice(["Alpha", "beta", "gamma", "é", "d1"]) for _ in range(k)) for k in (120, 200, 0, 90)] + ["", None, "x y"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    whole = {r.doc_id: r.token_f1 for r in queries.score_tokens(spark, str(tmp_path)).collect()}
    scores = {r.doc_id: r for r in queries.score_sequences(spark, str(tmp_path)).collect()}

    def plain(p, q):
        row = [0] * (len(q) + 1)
        for x in p:
            last = 0
            for j, y in enumerate(q, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return 2 * row[-1] / (len(p) + len(q)) if row[-1] else 0.0

    for k, (a, b) in enumerate(zip(texts, texts[1:])):
        a, b = a or "", b or ""
        p, q = (re.findall("[a-z0-9]+", t.lower()) for t in (a, b))
        n = sum((Counter(p) & Counter(q)).values())
        assert whole[k] == pytest.approx(2 * n / (len(p) + len(q)) if n else 0.0, abs=1e-6)
        assert scores[k].rouge_l == pytest.approx(plain(p, q)) and scores[k].ratio == pytest.approx(1.0 if a == b else plain(a, b))


def test_ranks_shuffle_whole_rows_once(spark):
    """Places over many ranges, with nulls and descending keys; what reads the ranges has no window over whole rows."""
    rng = random.Random(3)
    rows = [(k, rng.choice([None, "a", "b"]), rng.choice([None, 0.0, 0.5, 1.0])) for k in range(500)]
    got = prioritize.ranked(spark.createDataFrame(rows, "k long, name string, x double"), [F.asc("name"), F.desc("x"), F.col("k")])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and got.columns == ["k", "name", "x", "rank"]
    inorder = sorted(rows, key=lambda r: (r[1] or "", r[2] is None, -(r[2] or 0.0), r[0]))
    assert {r.k: r.rank for r in got.collect()} == {r[0]: i for i, r in enumerate(inorder, 1)}
    assert prioritize.ranked(spark.createDataFrame([], "k long"), [F.col("k")]).count() == 0


def test_subsequences_step_over_the_shorter_side():
    """Lengths are the plain definition's for texts and lists; a short text beside a long one takes few steps."""
    import time

    def plain(p, q):
        row = [0] * (len(q) + 1)
        for x in p:
            last = 0
            for j, y in enumerate(q, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(5)
    for k in range(200):
        a, b = ("".join(rng.choices("aé\U0001f600\ud800 b"[: rng.randint(1, 6)], k=rng.choice([0, 1, 5, 90, 300 if k % 20 == 0 else 40]))) for _ in range(2))
        assert similarity.lcs(a, b) == similarity.lcs(b, a) == similarity.lcs(list(a), list(b)) == plain(a, b)

    def steps_over_the_longer(a, b):  # as it was
        places = {}
        for i, x in enumerate(a):
            places[x] = places.get(x, 0) | 1 << i
        full = row = (1 << len(a)) - 1
        for place in map(places.get, b):
            if place is not None:
                match = row & place
                row = (row + match) | (row - match)
        return len(a) - (row & full).bit_count()

    def least(f):
        times = []
        for _ in range(5):
            start = time.process_time()
            n = f("x" + short + "y", "z" + long + "w")
            times.append(time.process_time() - start)
        return min(times), n

    short, long = "".join(rng.choices("abcdefghijklmnopqrst ", k=300)), "".join(rng.choices("abcdefghijklmnopqrst ", k=20_000))
    (now, n), (before, m) = least(similarity.lcs), least(steps_over_the_longer)
    assert n == m and now < before / 2


def test_pairs_of_documents_are_spread(spark, tmp_path, monkeypatch):
    """A table small enough for a broadcast, in one row group, still gives many tasks; more bytes give more of them."""
    from siftwell import queries

    rows = [(k, f"text {k}") for k in range(400)] + [(7, "another 7"), (8, None), (None, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    pairs = queries._neighbours(spark, str(tmp_path))
    assert pairs.rdd.getNumPartitions() >= 3 * cores
    sizes = [len(p) for p in pairs.rdd.glom().collect()]
    assert max(sizes) < 400 / cores
    wanted = sorted(((k, a, b) for k, a in rows for j, b in rows if k is not None and j == k + 1), key=str)
    assert sorted((tuple(r) for r in pairs.collect()), key=str) == wanted
    size = sum(f.stat().st_size for f in (tmp_path / "documents.parquet").glob("*.parquet"))
    most = max(3 * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))) + 5
    monkeypatch.setattr(queries, "_PAIRS_TASK", size // most)
    assert queries._neighbours(spark, str(tmp_path)).rdd.getNumPartitions() >= most


def test_words_and_places_by_bytes():
    """Words are those of the pattern in any alphabet; places are each symbol's, in one, two and four bytes a symbol."""
    import re

    rng = random.Random(6)
    odd = "aZ09 é\u0130\u017f\u212a\U0001f600\ud800_-\n\t\x00\x1f\x85\xa0\u2028"
    for _ in range(300):
        text = "".join(rng.choices(odd, k=rng.choice([0, 1, 7, 60])))
        assert similarity._words(text) == re.findall("[a-z0-9]+", text)
        assert similarity._words(text.lower()) == re.findall("[a-z0-9]+", text.lower())
    for symbols, n in (("abc", 50), ("abé\xff", 301), ("ab\u0100\u0161", 300), ("a\U0001f600\ud800", 299), ("abcdé", 1_100_000)):
        b = "".join(rng.choices(symbols, k=n))
        got = similarity._places(b, set(symbols))
        assert {x: bin(p)[:1:-1].ljust(n, "0") for x, p in got.items()} == {x: "".join("1" if y == x else "0" for y in b) for x in symbols}


def test_segments_of_reports_that_batches_cut(spark):
    """Many reports in batches of three lines give what each gives alone, without a window or a second shuffle."""
    for content, layout in ((NETWORK, segment.NETWORK), (WEB, segment.WEB)):
        alone = [tuple(r)[1:] for r in blocks(spark, content, layout)]
        df = spark.createDataFrame([(k, content if k % 3 else "nothing\nhere") for k in range(20)], "report_id long, text string")
        out = segment.segment(segment.lines(df), layout)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1
        was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        try:
            got = sorted(out.collect(), key=lambda r: (r.report_id, r.block_id))
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
        assert [tuple(r) for r in got] == [(k, *x) for k in range(20) if k % 3 for x in alone]


def test_rules_need_no_shuffle_and_lines_are_made_once(spark, tmp_path):
    import datetime

    from siftwell import queries
    from siftwell.operators import rules

    df = spark.createDataFrame([("r", 0, "High (CVSS: 9.8)\nNVT: a\nSummary:\n one \n\ntwo\nReferences\nBID: 1, 2", None, None), ("r", 1, "", None, None)], "report_id string, block_id int, text string, port string, protocol string")
    out = rules.network_fields(df)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.block_id: r for r in out.collect()}
    assert (got[0].name, got[0].cvss, got[0].description, got[0].references) == ("a", 9.8, ["one", "two"], ["BID:1", "BID:2"]) and (got[1].name, got[1].description) == ("", [])
    # Two findings at one place leave a block without sections.
    rows = [(2, 1, 3, 1, 5.0, "A", datetime.date(1995, 1, 1), 1.0, 0.0), (2, 1001, 3, 1, 5.0, "A", datetime.date(1995, 1, 1), 1.0, 0.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_shipdate date, l_extendedprice double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "a b", "C"), (1001, "d e", "F")], "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    assert len(queries.rule_fields(spark, str(tmp_path)).collect()) == 2
    assert queries.clean_lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().count("Host scan start today") <= 2


def test_packing_of_findings_with_one_place(spark, tmp_path):
    """Findings with one seq are packed alike, whatever order they come in."""
    import datetime

    from siftwell import queries

    rows = [(2, part, 3, line, 5.0, "A", datetime.date(1995, 1, 1), 1.0, 0.0) for part, line in ((7, 1), (1, 2), (1001, 2), (8, 3))]
    found = []
    for k, order in enumerate((rows, rows[::-1])):
        spark.createDataFrame(order, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_shipdate date, l_extendedprice double, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/{k}/lineitem.parquet")
        spark.createDataFrame([(1, "a" * 30, "C"), (1001, "d", "F"), (7, "g", "F"), (8, "h", "F")], "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/{k}/part.parquet")
        found.append(sorted((r.chunk, r.block_ids, r.tokens, r.oversized) for r in queries.pack_chunks(spark, f"{tmp_path}/{k}").collect()))
    assert found[0] == found[1] and len(found[0]) > 1
