"""Secret scans with one combined automaton for all rules.

Every text is passed once, byte by byte, through a minimal deterministic automaton that knows all rules and tells where
each rule's leftmost-longest matches that don't overlap end; their starts are walked back to. Matches that a rule's own
filter rejects (too short) are dropped without a second try. The time is in proportion to the text, however long a run
of hexadecimal digits or of value characters it holds.

The rule for hexadecimal runs counts to its least length itself: runs shorter than that would end a match at every word.
A leftmost run of at least 24 is the same as a leftmost run that is kept if it has 24.

Null and empty texts have no spans; an empty table gives an empty one; rows that repeat are each answered; columns beyond
doc_id and text aren't read. Places are in code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from siftwell.llm.automaton import Automaton
from siftwell.plans.staging import ship_package

#: Fixed rules: name, pattern, letters in either case, least length of the whole match, least length of the value.
BASE = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+""", True, 0, 6),
    ("access", r"AKIA[A-Z0-9]+", False, 20, 0),
    ("hex", r"[0-9a-f]{24,}", False, 24, 0),
)
#: Rules that add spans: published formats of keys.
MORE = (
    ("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", False, 0, 0),
    ("forge", r"gh[pousr]_[A-Za-z0-9]+", False, 40, 0),
    ("chat", r"xox[abprs]-[A-Za-z0-9\-]+", False, 15, 0),
    ("cloud", r"AIza[A-Za-z0-9_\-]+", False, 39, 0),
)
KINDS = tuple(r[0] for r in BASE + MORE)


@lru_cache(maxsize=1)
def automaton() -> Automaton:
    return Automaton([r[:3] for r in BASE + MORE])


def _value_length(match: bytes) -> int:
    """Length of an assignment's value: what follows its separator, blanks and quote."""
    k = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0) + 1
    while match[k : k + 1] == b" ":
        k += 1
    return len(match) - k - (match[k : k + 1] in (b'"', b"'"))


def secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each secret, by start, then kind as listed."""
    data = (text or "").encode()
    found = []
    for k, a, z in automaton().spans(data):
        _, _, _, least, value = (BASE + MORE)[k]
        if z - a >= least and (not value or _value_length(data[a:z]) >= value):
            found.append((a, k, z))
    found.sort()
    if text is None or text.isascii():
        return [(KINDS[k], a, z) for a, k, z in found]
    # Code points before each place, counted from one place to the next.
    places, at, seen = {}, 0, 0
    for i in sorted({i for a, _, z in found for i in (a, z)}):
        seen += len(data[at:i].decode())
        places[i], at = seen, i
    return [(KINDS[k], places[a], places[z]) for a, k, z in found]


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id and the array of its secrets (kind, start, end), a row for each row of docs."""
    ship_package(docs.sparkSession)
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [[{"kind": k, "start": a, "end": z} for k, a, z in secrets(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(span))], names=["doc_id", "secrets"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, secrets array<struct<kind:string,start:int,end:int>>")


def digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of the base kinds, the hash of their spans, and all spans."""
    ship_package(docs.sparkSession)
    base = tuple(r[0] for r in BASE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                got = secrets(t.as_py())
                own = [x for x in got if x[0] in base]
                join = lambda xs: ",".join(f"{k}:{a}:{z}" for k, a, z in xs)
                rows.append((*(sum(x[0] == k for x in own) for k in base), hashlib.sha256(join(own).encode()).hexdigest(), join(got)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
