"""Report lines to blocks, one for each finding, by a pass over the lines of whole reports."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.plans.staging import ship_package


@dataclass(frozen=True)
class Layout:
    """How a scanner's reports are laid out; patterns are Java's, with numbered groups."""

    name: str
    marker: str
    source: str = ""
    max_blocks: int = 4
    discard: tuple[str, ...] = ()
    #: (pattern, group of the port, group of the protocol)
    headers: tuple[tuple[str, int, int], ...] = ()
    host_anchor: str | None = None
    host_line: str | None = None
    name_above: bool = False
    name_stop: str | None = None
    key_parts: tuple[str, ...] = ("port", "protocol")
    fields: dict = field(default_factory=dict, hash=False)


_SEVERITY = "(Critical|High|Medium|Low|Log)"
#: The layouts of the three known scanners.
NETWORK = Layout(
    "openvas", r"^\s*(Critical|High|Medium|Low|Log)\s+\(CVSS:", "OPENVAS", 4, (r"(?:\d+\s+)?Results\s+per\s+Host(?:\s+\d+)?",),
    ((rf"^(?:#+\s+)?(?:\d+(?:\.\d+)*\s+)?{_SEVERITY}\s+(\d+|general)/([a-zA-Z0-9_-]+)", 2, 3), (rf"^(?:#+\s+)?(\d+|general)/([a-zA-Z0-9_-]+)\s+{_SEVERITY}", 1, 2)),
    r"^\s*host scan start", r"^\s*(?:\d+(?:\.\d+)*\s+)?((?:\d{1,3}\.){3}\d{1,3})\s*$",
    fields={"cvss": "number", "insight": "list", "detection_result": "list", "detection_method": "list", "product_detection_result": "list", "log_method": "list"},
)
WEB = Layout(
    "tenable", r"(?i)(?:#+\s+)?(?:\d+(?:\.\d+)*\s+)?VULNERABILITY\s+(CRITICAL|HIGH|MEDIUM|LOW|INFO)\s+PLUGIN\s+ID\s+\d+", "TENABLEWAS", 3, name_above=True,
    name_stop=r"^\s*(Description|Solution|Risk Information|Plugin Details|Reference Information|Identification|HTTP Info|See Also|BID\b|CWE\b|WASC\b|OWASP\b|CVE\b).*$|^\s*https?://",
    key_parts=("severity", "plugin"), fields={"cvss": "list", "plugin": "int", "plugin_details": "PluginDetails", "instances": "[Instance]"},
)
HOST = Layout(
    "qualys", r"^\s*([1-5])\s+[A-Za-z]", "QUALYS", 3, (r"[1-5]\s+(?:Minimal|Medium|Serious|Critical|Urgent)\b.*", r"\d+\s+Biggest Categories"), (),
    r"^(?:(?:Potential\s+)?Vulnerabilities|Information\s+Gathered)\s*\(\d+\)", r"^((?:\d{1,3}\.){3}\d{1,3})\s*\(", fields={"category": "str", "plugin": "int"},
)
LAYOUTS = {x.name: x for x in (NETWORK, WEB, HOST)}


def load_layout(text: str) -> Layout:
    """A layout from a scanner's JSON; named groups become numbered ones."""
    c = json.loads(text)
    context, pair = c.get("context") or {}, c.get("evaluation") or {}
    headers = []
    for p in context.get("header_patterns", []):
        names = re.compile(p).groupindex
        headers.append((re.sub(r"\(\?P<\w+>", "(", p), names["port"], names["proto"]))
    return Layout(
        c["name"], c["marker_pattern"], c.get("source", c["name"].upper()), c.get("max_vulns_per_chunk", 4), tuple(c.get("discard_patterns", ())), tuple(headers), context.get("host_anchor"), context.get("host_line"),
        c.get("name_above_marker", False), c.get("name_stop_pattern"), tuple(pair.get("key_parts", ("port", "protocol"))), c.get("fields", {}),
    )


def lines(reports: DataFrame) -> DataFrame:
    """report_id, pos, line of reports (report_id, text); a last empty line isn't one."""
    at = F.posexplode(F.split(F.regexp_replace("text", r"\R\z", ""), r"\R", -1)).alias("pos", "line")
    return reports.select("report_id", at)


def _found(line: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, group), F.lit(""))


#: What Java's \\s matches.
BLANKS = " \t\n\x0b\f\r"


def segment(rows: DataFrame, layout: Layout) -> DataFrame:
    """Lines (report_id, pos, line) to blocks (report_id, block_id, text, host, port, protocol, severity_hint).

    Host, port and protocol stay until a later line changes them; a block starts at its marker, or at the name above it.
    Patterns are looked for in each line by itself, blank ones aside; one shuffle by report then brings a report's lines
    together in order, and a pass over whole reports carries forward and joins with array operations.
    """
    ship_package(rows.sparkSession)
    like = lambda c, p: F.coalesce(F.regexp_like(c, F.lit(p)), F.lit(False))
    no, none, filled = F.lit(False), F.lit(None).cast("string"), F.col("bare") != ""
    df = rows.select("report_id", "pos", "line", F.btrim("line", F.lit(BLANKS)).alias("bare"))
    blank_matches = lambda p: re.search(p, "") is not None
    for p in layout.discard:
        hit = F.regexp_like("bare", F.lit(f"(?i)^(?:{p})$"))
        df = df.where(~(hit if blank_matches(f"^(?:{p})$") else filled & hit))
    seen = lambda c, p: like(c, p) if blank_matches(p) else F.coalesce(filled, no) & like(c, p)
    df = df.withColumn("marker", seen("line", layout.marker))
    hint = F.when(F.col("marker"), F.nullif(F.upper(F.regexp_extract("line", layout.marker, 1)), F.lit("")))
    anchor, host = no, none
    if layout.host_anchor and layout.host_line:
        anchor, host = seen("line", f"(?i){layout.host_anchor}"), F.when(filled, _found(F.col("line"), layout.host_line, 1))
    port = protocol = none
    for p, of_port, of_protocol in reversed(layout.headers):
        hit = seen("bare", f"(?i){p}")
        port = F.when(hit, _found(F.col("bare"), f"(?i){p}", of_port)).otherwise(port)
        protocol = F.when(hit, F.lower(_found(F.col("bare"), f"(?i){p}", of_protocol))).otherwise(protocol)
    tail = stop = no
    if layout.name_above:
        tail = filled & like("bare", r"(?i)^(\(\d+\)|Instances(\s*\(\d+\))?)\s*$")
        stop = filled & like("bare", f"(?i){layout.name_stop}") if layout.name_stop else no
    flags = F.coalesce(filled, no).cast("int") + F.col("marker").cast("int") * 2 + anchor.cast("int") * 4 + F.coalesce(tail, no).cast("int") * 8 + F.coalesce(stop, no).cast("int") * 16 + (32 if layout.name_above else 0)
    marked = df.select("report_id", "pos", "line", flags.alias("flags"), hint.alias("hint"), host.alias("host"), port.alias("port"), protocol.alias("protocol"))
    # Lines at one place go by their content, so that reruns agree.
    ordered = marked.repartition("report_id").sortWithinPartitions("report_id", "pos", "line").drop("pos")
    kind = dict(rows.dtypes)["report_id"]
    return ordered.mapInArrow(_whole_reports, f"report_id {kind}, block_id int, text string, host string, port string, protocol string, severity_hint string")


def _whole_reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the reports that a task's batches of ordered lines hold; the last report of a batch waits for the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _report_starts(batch.column(0))
        if held and not _same(held[-1].column(0)[-1], batch.column(0)[0]):
            yield from _blocks_of(held)
            held = []
        if len(starts) > 1:
            yield from _blocks_of([*held, batch.slice(0, starts[-1])])
            held = []
        held.append(batch.slice(starts[-1]) if len(starts) > 1 else batch)
    if held:
        yield from _blocks_of(held)


def _same(a: pa.Scalar, b: pa.Scalar) -> bool:
    return a.as_py() == b.as_py()


def _report_starts(ids: pa.Array) -> np.ndarray:
    """Places where another report starts; null is a report too."""
    codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))


def _blocks_of(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole reports, whose lines are in order."""
    whole = pa.Table.from_batches(batches).combine_chunks()
    ids, line, flags, hint, host, port, protocol = (c.chunk(0) for c in whole.columns)
    bits, at = flags.to_numpy(), np.arange(len(ids))
    filled, marker, anchor, tail, stop = ((bits & k) > 0 for k in (1, 2, 4, 8, 16))
    starts = _report_starts(ids)
    first = np.repeat(starts, np.diff([*starts, len(ids)]))

    def latest(where: np.ndarray) -> np.ndarray:
        """The last place up to each line of its report that is so, else -1."""
        last = np.maximum.accumulate(np.where(where, at, -1))
        return np.where(last >= first, last, -1)

    def earlier(last: np.ndarray) -> np.ndarray:
        before = np.concatenate([[-1], last[:-1]])
        return np.where(before >= first, before, -1)

    known = lambda c: c.is_valid().to_numpy(zero_copy_only=False)
    above = earlier(latest(filled))
    of_host = latest(anchor & (above >= 0) & known(host)[above])
    of_host = np.where(of_host >= 0, above[of_host], -1)
    marks = np.flatnonzero(marker)
    if not len(marks):
        return
    last = earlier(latest(marker))[marks]
    free = lambda k: (marks - k > last) & (marks - k >= first[marks]) & filled[marks - k] & ~stop[marks - k]
    up = np.zeros(len(marks), dtype="int64")
    if (bits & 32).any():
        up = np.where(free(1), np.where(tail[marks - 1] & free(2), 2, 1), 0)
    begins = marks - up
    fresh = np.concatenate([[True], first[marks][1:] != first[marks][:-1]])
    order = np.arange(len(marks))
    block = (order - np.maximum.accumulate(np.where(fresh, order, 0))).astype("int32")
    inside = np.repeat(begins, np.diff([*begins, len(ids)]))  # where the block of a line begins, if its report has begun one
    taken = np.zeros(len(ids), dtype=bool)
    taken[begins[0] :] = inside >= first[begins[0] :]
    taken &= known(line)
    counts = np.concatenate([[0], np.cumsum(taken)])
    lines = line.filter(pa.array(taken))
    offsets = pa.array(counts[[*begins, len(ids)]].astype("int32"))
    text = pc.ascii_trim(pc.binary_join(pa.ListArray.from_arrays(offsets, lines), "\n"), characters=BLANKS)
    pick = lambda c, places: c.take(pa.array(np.maximum(places, 0), mask=places < 0))
    columns = [ids.take(pa.array(marks)), pa.array(block), text, pick(host, of_host[marks]), pick(port, latest(known(port))[marks]), pick(protocol, latest(known(protocol))[marks]), hint.take(pa.array(marks))]
    yield pa.RecordBatch.from_arrays(columns, names=["report_id", "block_id", "text", "host", "port", "protocol", "severity_hint"])


def unsegmented(reports: DataFrame, blocks: DataFrame) -> DataFrame:
    """Reports without any block."""
    return reports.join(blocks.select("report_id").distinct(), "report_id", "left_anti")
