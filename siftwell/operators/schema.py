"""Record types: the core fields, what a scanner adds, and what follows from them.

A record type is a StructType. Metadata of a field say whether an extractor produces it (`produced`), whether its values are
from a fixed list (`one_of`), and what an empty cell of it becomes (`blank`).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, MapType, NumericType, StringType, StructField, StructType

# Names and domains of the record format.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "LOG", "INFO")
PROTOCOLS = ("tcp", "udp")
DETAILS = ("publication_date", "modification_date", "family", "severity")
INSTANCE = ("instance", "input_type", "input_name", "payload", "proof", "output", "request_method", "http_protocol", "response_content_type")
SCANNERS = {
    "openvas": ("OPENVAS", {"cvss": "number", "insight": "list", "detection_result": "list", "detection_method": "list", "product_detection_result": "list", "log_method": "list"}),
    "tenable": ("TENABLEWAS", {"cvss": "list", "plugin": "int", "plugin_details": "PluginDetails", "instances": "[Instance]"}),
    "qualys": ("QUALYS", {"category": "str", "plugin": "int"}),
}

_LINES = ArrayType(StringType())
PLAIN: dict[str, DataType] = {"str": StringType(), "list": _LINES, "int": LongType(), "float": DoubleType(), "number": DoubleType()}
MODELS: dict[str, StructType] = {
    "PluginDetails": StructType([*(StructField(n, StringType()) for n in DETAILS), StructField("plugin_id", LongType())]),
    "Instance": StructType([*(StructField(n, StringType()) for n in INSTANCE[:7]), StructField("http_status_code", LongType()), *(StructField(n, StringType()) for n in INSTANCE[7:])]),
}
CORE = StructType(
    [StructField("name", StringType(), False), *(StructField(n, _LINES) for n in ("description", "solution", "impact", "references")), StructField("severity", StringType(), False, {"one_of": list(SEVERITIES)})]
    + [StructField("host", StringType(), True, {"produced": False}), StructField("port", StringType(), True, {"mixed": True}), StructField("protocol", StringType(), True, {"one_of": list(PROTOCOLS)}), StructField("source", StringType(), True, {"produced": False})]
)


def field(scanner: str, name: str, kind: str) -> StructField:
    """A scanner's own field from a word of the type vocabulary."""
    if kind in PLAIN:
        return StructField(name, PLAIN[kind])
    if kind in MODELS:
        return StructField(name, MODELS[kind], True, {"blank": "{}"})
    if kind.startswith("[") and kind.endswith("]") and kind[1:-1] in MODELS:
        return StructField(name, ArrayType(MODELS[kind[1:-1]]), True, {"blank": "[]"})
    raise ValueError(f"scanner {scanner!r}: field {name!r} has the unknown type {kind!r}; there are {', '.join(sorted(PLAIN))}, {', '.join(sorted(MODELS))} and lists of the latter, as [Instance]")


def record_type(scanner: str = "generic", fields: Mapping[str, str] | None = None) -> StructType:
    """Core fields and those that a scanner declares; a declared name takes the core field's place."""
    own = [field(scanner, n, k) for n, k in (fields if fields is not None else SCANNERS.get(scanner, ("", {}))[1]).items()]
    names = {f.name for f in own}
    return StructType([f for f in CORE.fields if f.name not in names] + own)


def type_of_source(source: str | None) -> StructType:
    """The record type of the scanner that stamps records with this source; the core for any other."""
    return next((record_type(name) for name, (mark, _) in SCANNERS.items() if mark == source), CORE)


def produced(kind: StructType) -> list[StructField]:
    return [f for f in kind.fields if f.metadata.get("produced", True)]


def contract(kind: StructType) -> StructType:
    """What an extractor must answer with: items of block_id and the fields that it produces, nothing else."""
    item = StructType([StructField("block_id", LongType(), False), *produced(kind)])
    return StructType([StructField("items", ArrayType(item), False)])


def json_schema(kind: DataType, metadata: Mapping | None = None, nullable: bool = False) -> dict:
    """A type as JSON Schema, closed: objects take no further keys."""
    if isinstance(kind, StructType):
        name = lambda f: "Name" if f.name == "name" else f.name
        return {"type": "object", "properties": {name(f): json_schema(f.dataType, f.metadata, f.nullable) for f in kind.fields}, "required": [name(f) for f in kind.fields if not f.nullable], "additionalProperties": False}
    if isinstance(kind, ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    if isinstance(kind, MapType):
        return {"type": "object", "additionalProperties": json_schema(kind.valueType)}
    plain = "boolean" if isinstance(kind, BooleanType) else "integer" if isinstance(kind, LongType) else "number" if isinstance(kind, NumericType) else "string"
    some = [plain, "integer"] if (metadata or {}).get("mixed") else [plain]
    out: dict = {"type": [*some, "null"]} if nullable else {"type": some if len(some) > 1 else plain}
    if (metadata or {}).get("one_of"):
        out["enum"] = [*metadata["one_of"], *([None] if nullable else [])]
    return out


def unblanked(raw: Column, kind: StructField) -> Column:
    """A structured field's JSON text; empty cells and dashes become the empty value of its kind."""
    text = F.trim(raw)
    blank = kind.metadata.get("blank")
    return F.when(text.isNull() | text.isin("", "-"), blank).otherwise(raw) if blank else raw


def violations(records: DataFrame, kind: StructType) -> DataFrame:
    """records with `violations`: names of the fields whose values are missing or outside their domain."""
    checks = []
    for f in kind.fields:
        if f.name not in records.columns:
            continue
        c = F.col(f"`{f.name}`")
        bad = c.isNull() if not f.nullable else F.lit(False)
        if f.metadata.get("one_of"):
            bad = bad | (c.isNotNull() & ~c.isin(*f.metadata["one_of"]))
        checks.append(F.when(bad, f.name))
    return records.withColumn("violations", F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"))


def listing(spark: SparkSession) -> DataFrame:
    """column, type, origin of every field: the core's, then those of scanners, by name, with the scanners that have it."""
    rows = [("Name" if f.name == "name" else f.name, f.dataType.simpleString(), "core") for f in CORE.fields]
    more: dict[tuple[str, str], list[str]] = {}
    for scanner in sorted(SCANNERS):
        for name, kind in SCANNERS[scanner][1].items():
            more.setdefault((name, field(scanner, name, kind).dataType.simpleString()), []).append(scanner)
    return spark.createDataFrame(rows + [(n, k, "+".join(s)) for (n, k), s in more.items()], "column string, type string, origin string")
