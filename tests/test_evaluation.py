"""Types, scorers, alignment of records without names, evaluation and documents, on small rows with odd values."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from siftwell.functions import scoring
from siftwell.operators import align, baselines, consolidate, evaluate, exports, prioritize, reconcile, schema
from siftwell.plans.staging import ship_package


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def test_record_types():
    kind = schema.record_type("tenable")
    assert kind["instances"].dataType.elementType.fieldNames()[0] == "instance" and kind["cvss"].dataType.simpleString() == "array<string>"
    assert schema.type_of_source("OPENVAS")["cvss"].dataType.simpleString() == "double" and schema.type_of_source("other") == schema.CORE
    item = schema.contract(kind)["items"].dataType.elementType
    assert item.fieldNames()[0] == "block_id" and "host" not in item.fieldNames() and "source" not in item.fieldNames()
    emitted = schema.json_schema(schema.contract(kind))
    one = emitted["properties"]["items"]["items"]
    assert emitted["additionalProperties"] is False and one["additionalProperties"] is False and "Name" in one["properties"] and one["required"] == ["block_id", "Name", "severity"]
    assert one["properties"]["protocol"]["enum"] == ["tcp", "udp", None] and one["properties"]["port"]["type"] == ["string", "integer", "null"]
    with pytest.raises(ValueError, match="unknown type"):
        schema.record_type("x", {"a": "date"})


def test_domains_and_listing(spark):
    rows = spark.createDataFrame([("a", "HIGH", "tcp"), (None, "high", None), ("b", "LOG", "icmp")], "name string, severity string, protocol string")
    assert [r.violations for r in schema.violations(rows, schema.CORE).collect()] == [[], ["name", "severity"], ["protocol"]]
    listed = {(r.column, r.type): r.origin for r in schema.listing(spark).collect()}
    assert listed["Name", "string"] == "core" and listed["plugin", "bigint"] == "qualys+tenable" and listed["cvss", "double"] == "openvas"
    blank = spark.createDataFrame([("-",), ("",), (None,), ('{"family":"x"}',)], "x string").select(schema.unblanked(F.col("x"), schema.record_type("tenable")["plugin_details"]).alias("x"))
    assert [r.x for r in blank.collect()] == ["{}", "{}", "{}", '{"family":"x"}']


def test_field_plans():
    plans = {p.name: p.metric for p in evaluate.field_plans(schema.record_type("tenable"))}
    assert plans == {"name": "text", "description": "text", "solution": "text", "impact": "text", "references": "set_f1_ids", "severity": "exact", "port": "exact", "protocol": "exact", "cvss": "text", "plugin": "exact", "plugin_details": "structural", "instances": "structural"}
    changed = {p.name: p.metric for p in evaluate.field_plans(schema.CORE, {"references": "set_f1", "impact": "skip"})}
    assert changed["references"] == "set_f1" and "impact" not in changed
    with pytest.raises(ValueError, match="unknown scorers"):
        evaluate.field_plans(schema.CORE, {"impact": "bleu"})


def test_registry():
    assert [s.name for s in scoring.chosen("all")] == ["token_f1", "rouge_l"] and [s.name for s in scoring.chosen(" Rouge , token_f1")] == ["rouge_l", "token_f1"]
    with pytest.raises(ValueError, match="no text scorer"):
        scoring.chosen("exact")
    with pytest.raises(RuntimeError, match="register"):
        scoring.chosen("bert")
    assert evaluate.metric_order(["token_f1", "structural", "exact", "bleu"]) == ["exact", "structural", "bleu", "token_f1"]


def test_rendering_and_numbers(spark):
    rows = spark.createDataFrame([(["a ", "", None, "b"], (" x ", None, 3), True, {"k": "v", "e": ""}, " 1_0 "), (None, None, None, None, "12d")], "a array<string>, s struct<x:string,y:string,n:int>, t boolean, m map<string,string>, n string")
    shown = rows.select(*[scoring.render_text(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema.fields], scoring.as_number(F.col("n"), StringType()).alias("number")).collect()
    assert tuple(shown[0]) == ("a\nb", "x: x\nn: 3", "True", "k: v", "1_0", 10.0) and tuple(shown[1]) == ("", "", "", "", "12d", None)


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [
        ("http://h/#/login", "http://h/#/admin", None), ("http://h/a/", "HTTP://H/a", 1.0), ("http://h", "https://h/", 1.0), ("http://h/a?x=1", "http://h/a?x=2", 0.8 * 10 / 12 + 0.2), ("abc", "abd", 4 / 6), ("http://h/a", "plain", None),
    ],
)
def test_key_similarity(spark, a, b, expected):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(scoring.key_similarity(F.col("a"), F.col("b"))).first()[0]
    assert got == pytest.approx(scoring.plain_key_similarity(a, b)) and (expected is None or got == pytest.approx(expected))


def test_structural_scores(spark):
    kind = StructType.fromDDL("e array<struct<instance:string,method:string,code:bigint>>, b array<struct<instance:string,method:string,code:bigint>>")
    one = ("http://h/login", "GET", 200)
    rows = [([one, ("http://h/admin", "POST", None)], [("http://h/admin", "POST", 5), one]), ([one], [one, ("http://h/other/place", None, None)]), ([], []), (None, [one]), ([("http://h/x/y/z", "GET", 1)], [("http://h/quite/else", "GET", 1)])]
    item = kind["e"].dataType
    score, vacuous = scoring.present(scoring.structural_score(F.col("e"), F.col("b"), item), F.col("e"), F.col("b"), item)
    got = [tuple(r) for r in spark.createDataFrame(rows, kind).select(score, vacuous).collect()]
    assert got == [((1.0 + 2 / 3) / 2, False), (0.5, False), (1.0, True), (0.0, False), (0.0, False)]
    maps = spark.createDataFrame([({"a": "x y", "n": "1"}, {"a": "x", "n": "1.0", "c": "z"})], "e map<string,string>, b map<string,string>")
    assert maps.select(scoring.structural_score(F.col("e"), F.col("b"), maps.schema["e"].dataType)).first()[0] == pytest.approx((2 / 3 + 1 + 0) / 3)


def test_unnamed_records(spark):
    """Without names keys decide alone: known parts count 1, wildcards 0.3; conflicts count nothing."""
    cols = "run_id string, idx long, name string, port string, protocol string"
    ext = align.keyed(spark.createDataFrame([("r", 0, None, None, None), ("r", 1, " ", "80", "tcp"), ("r", 2, "", "81", None), ("r", 3, "named", None, None)], cols), ("port", "protocol"))
    base = align.keyed(spark.createDataFrame([("r", 0, "", "80", "tcp"), ("r", 1, None, "99", "udp"), ("r", 2, "Named", "1", "tcp")], cols), ("port", "protocol"))
    cells = {(r.ext_idx, r.base_idx): round(r.similarity, 4) for r in align.pair_similarity(ext, base, least=0.0).collect()}
    assert cells[0, 0] == cells[0, 1] == 0.5333 and cells[1, 0] == 1.0 and cells[1, 1] == cells[2, 0] == 0.0 and cells[3, 2] == 1.0 and cells[3, 0] == 0.0
    pairs = align.assign(ext, base)
    assert {(r.ext_idx, r.base_idx) for r in pairs.collect()} == {(1, 0), (3, 2)}
    rows = {r.ext_idx: (r.status, r.base_idx, r.similarity) for r in align.mapping(ext, base, pairs).collect()}
    assert rows == {0: ("UNMATCHED", None, 0.0), 1: ("MATCHED", 0, 1.0), 2: ("UNMATCHED", None, 0.0), 3: ("MATCHED", 2, 1.0)}


def test_assignment_passes_runs_over_batches(spark):
    """Runs of many sizes, some with one side only, in batches that cut them."""
    cols = "run_id long, idx long, name string, port string, protocol string"
    rows = [(k, i, f"finding {i} of {k}", str(i), "tcp") for k in range(40) for i in range(k % 7 * 9)]
    ext, base = (align.keyed(spark.createDataFrame(x, cols), ("port", "protocol")) for x in ([r for r in rows if r[0] % 5], [r for r in rows if r[0] % 3]))
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {(r.run_id, r.ext_idx, r.base_idx) for r in align.assign(ext, base).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert got == {(k, i, i) for k, i, *_ in rows if k % 5 and k % 3}


def test_evaluation_without_records(spark):
    rows = spark.createDataFrame([], "run_id string, idx long, name string")
    with pytest.raises(ValueError, match="truth"):
        evaluate.evaluate_run(rows, None, schema.CORE)
    with pytest.raises(ValueError, match="no extracted"):
        evaluate.evaluate_run(rows, rows, schema.CORE)
    assert evaluate.unevaluated(spark.createDataFrame([], "run_id string, idx long, Name string, Severity string, Remark string, age int"), schema.CORE) == ["Remark", "age"]


def test_documents(spark):
    cols = "seq long, name string, severity string, description array<string>, solution array<string>, impact array<string>, references array<string>, host string, port string, protocol string, source string, cvss_lines array<string>"
    rows = [(1, "One", "HIGH", ["a"], ["fix"], [], ["CVE-2020-1234"], "h1", "80", "tcp", "S", ["CVSSV3 BASE SCORE 7.5", "CVSSV3 VECTOR CVSS:3.1/AV:N"]), (2, 'Two "q"', "LOG", [], [], [], [], None, None, None, "S", [])]
    records = spark.createDataFrame(rows, cols)
    generic = json.loads(exports.generic_document(records).first()[0])
    assert [f["title"] for f in generic["findings"]] == ["One", 'Two "q"'] and generic["findings"][0]["cve"] == "CVE-2020-1234" and "cve" not in generic["findings"][1]
    csaf = json.loads(exports.csaf_document(records, "2026-01-02T03:04:05Z").first()[0])
    first, second = csaf["vulnerabilities"]
    assert csaf["document"]["tracking"]["current_release_date"] == "2026-01-02T03:04:05Z" and csaf["product_tree"]["full_product_names"] == [{"name": "h1", "product_id": "HOST-1"}]
    assert first["scores"][0]["cvss_v3"] == {"version": "3.1", "vectorString": "CVSS:3.1/AV:N", "baseScore": 7.5, "baseSeverity": "HIGH"} and first["product_status"] == {"known_affected": ["HOST-1"]} and "scores" not in second and second["notes"][0]["text"] == 'Two "q"'


def test_queue_of_records(spark):
    cols = "seq long, name string, host string, severity string, references array<string>, plugin_details struct<family:string>, instances array<struct<instance:string>>, cvss_score double"
    rows = [(1, "a", "", "HIGH", ["see"], ("cve-2020-1111",), [("",), ("https://Shop.example/x",)], 9.8), (2, "b", "10.0.0.1", "LOW", ["CVE-2021-2222"], None, [], None), (3, "c", None, "LOW", [], None, None, None)]
    records = spark.createDataFrame(rows, cols)
    found = {r.seq: r for r in prioritize.findings_of(records).collect()}
    assert found[1].host == "https://Shop.example/x" and "cve-2020-1111" in found[1].reference and found[2].host == "10.0.0.1" and found[3].host is None
    kev, epss = spark.createDataFrame([("CVE-2020-1111",)], "cve string"), spark.createDataFrame([], "cve string, epss double")
    assert prioritize.queue_of(records, kev, epss).count() == 3
    with pytest.raises(ValueError, match="both"):
        prioritize.queue_of(records, kev.limit(0), epss)


def test_small_parts_of_extraction(spark):
    rows = spark.createDataFrame([(4096, 8192, "x" * 300), (4096, 512, "x" * 900), (100, 8192, "")], "most int, context int, prompt string")
    assert [r[0] for r in rows.select(reconcile.answer_limit(F.col("most"), F.col("context"), F.col("prompt"))).collect()] == [4096, 256, 256]
    raw, final = spark.createDataFrame([("a",), ("a",), ("b",)], "report_id string"), spark.createDataFrame([("a",)], "report_id string")
    assert {tuple(r) for r in consolidate.counts(raw, final).collect()} == {("a", 2, 1), ("b", 1, 0)}
    blocks = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "report_id string, block_id int")
    assert [r.block_id for r in reconcile.in_block_order(blocks).collect() if r.report_id == "a"] == [1, 3]


def test_truth_is_normalised(spark):
    rows = spark.createDataFrame([(" high", "['CVE-2020-1', ' b ']"), ("odd ", "x\n\n y"), (None, None), ("LOG", "[broken")], "severity string, references string")
    got = [tuple(r) for r in rows.select(baselines.severity_tier(F.col("severity")), baselines.reference_list(F.col("references"))).collect()]
    assert got == [("HIGH", ["CVE-2020-1", "b"]), ("odd", ["x", "y"]), (None, []), ("LOG", ["[broken"])]
    table = spark.createDataFrame([(1, "a", "x")], "more int, b string, old string")
    assert baselines.canonical(table, ["a", "b"], ("old",)).columns == ["a", "b", "more"]
    cols = "pos long, severity string, references string, note string"
    before = spark.createDataFrame([(1, "high", "CVE-2020-1111, CVE-2020-2222", "n"), (2, "LOW", "", "m"), (3, "LOW", None, "k")], cols)
    after = spark.createDataFrame([(1, "HIGH", "cve 2020-2222\nCVE-2020-1111", "n "), (2, "LOW", None, "other"), (3, "LOG", None, "again")], cols)
    assert {tuple(r) for r in baselines.changed_cells(before, after, ["severity", "references", "note"]).collect()} == {("severity", 3, 1), ("note", 2, 2)}


def test_assignment_of_pairs_above_the_threshold(spark):
    """A pair that is alike enough doesn't give way to two that aren't, where these count for nothing."""
    cols = "run_id string, idx long, name string, port string, protocol string"
    ext = align.keyed(spark.createDataFrame([("r", 0, "aaaaaaaabb", "1", "tcp"), ("r", 1, "bb", "1", "tcp")], cols), ("port", "protocol"))
    base = align.keyed(spark.createDataFrame([("r", 0, "aaaaaaaabb", "2", "tcp"), ("r", 1, "aaaaaaaacc", "2", "tcp")], cols), ("port", "protocol"))
    assert {(r.ext_idx, r.base_idx) for r in align.assign(ext, base, cut_first=True).collect()} == {(0, 0)}
    assert {(r.ext_idx, r.base_idx) for r in align.assign(ext, base).collect()} == {(0, 1)}
    parts = [["1"]] * 4
    for seed in range(200):
        rng = random.Random(seed)
        names, others = (["".join(rng.choice("ab") for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 4))] for _ in range(2))
        for least in (0.0, 0.7):
            matrix = align.similarities(names, parts, others, parts)
            worth = [[x if x >= least else 0.0 for x in row] for row in matrix]
            short, long = (worth, len(others)) if len(names) <= len(others) else (list(zip(*worth)), len(names))
            best = max(sum(short[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(long), len(short)))
            got = align.best_pairs(names, parts, others, parts, align.Lengths(6).of, least)
            assert sum(s for *_, s in got if s >= least) == pytest.approx(best) and len({i for i, *_ in got}) == len({j for _, j, _ in got}) == len(got)


def test_words_of_columns_and_lambdas_agree(spark):
    rows = [("", None), ("a b a", "A a c"), ("É x1 x1", "x1 é"), (None, None), ("...", "a"), ("\u212aelvin \u0130i", "kelvin i")]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select(scoring.text_f1(F.col("a"), F.col("b")).alias("x"), scoring.token_f1(F.col("a"), F.col("b")).alias("y")).collect():
        assert r.x == r.y


def test_evaluation_scores_only_when_asked(spark):
    """Alignment alone stages no scores."""
    rows = spark.createDataFrame([("r", 1, "a b", "high")], "run_id string, idx long, name string, severity string")
    got = evaluate.evaluate_run(rows, rows, schema.CORE)
    assert "scores" not in vars(got) and got.pairs.count() == 1 and got.mapping.first().status == "MATCHED" and "scores" not in vars(got)
    assert {r.field: r.mean for r in got.fields.collect()}["severity"] == 1.0
