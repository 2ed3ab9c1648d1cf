"""Scores of field values of any type: rendering, leaves, structs, lists of structs, and the registry of scorers.

Nothing here looks at rows: a scorer takes two columns and their type and gives a column. Presence comes first everywhere:
two empty values score 1 and are marked vacuous, an empty and a filled one score 0.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, MapType, NullType, NumericType, StructType

from siftwell.functions import similarity
from siftwell.functions.similarity import f1, identifiers, indel_ratio, lcs, rouge_l, text_f1, token_f1
from siftwell.functions.text import once, tokens

#: Items of lists are paired from this similarity of their keys on.
ITEM_THRESHOLD = 0.7
#: What a text must look like to count as a number.
NUMBER = r"(?i)^[+-]?(?:[0-9]+(?:_[0-9]+)*(?:\.(?:[0-9]+(?:_[0-9]+)*)?)?|\.[0-9]+)(?:e[+-]?[0-9]+)?$|^[+-]?(?:nan|inf|infinity)$"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def render_text(value: Column, kind: DataType) -> Column:
    """The text form of a value, never null: list items and `key: value` lines that aren't empty, joined by line breaks."""
    if isinstance(kind, NullType):
        return F.lit("")
    if isinstance(kind, ArrayType):
        parts = F.filter(F.transform(value, lambda x: render_text(x, kind.elementType)), lambda t: t != "")
        return F.coalesce(F.array_join(parts, "\n"), F.lit(""))
    if isinstance(kind, StructType):
        lines = [_line(f.name, render_text(value[f.name], f.dataType)) for f in kind.fields]
        return F.coalesce(F.when(value.isNotNull(), F.concat_ws("\n", *lines)), F.lit(""))
    if isinstance(kind, MapType):
        lines = F.transform(F.map_entries(value), lambda e: _line_of(e["key"], render_text(e["value"], kind.valueType)))
        return F.coalesce(F.array_join(F.filter(lines, lambda t: t.isNotNull()), "\n"), F.lit(""))
    if isinstance(kind, BooleanType):
        return F.when(value.isNull(), "").when(value, "True").otherwise("False")
    return F.coalesce(_stripped(value.cast("string")), F.lit(""))


def _line_of(key: Column, text: Column) -> Column:
    return F.when(text != "", F.concat(key, F.lit(": "), text))


def _line(key: str, text: Column) -> Column:
    return _line_of(F.lit(key), text)


def as_number(value: Column, kind: DataType) -> Column:
    """The value as a number, null if it is none; truth values are none."""
    if isinstance(kind, BooleanType | NullType | ArrayType | StructType | MapType):
        return F.lit(None).cast("double")
    if isinstance(kind, NumericType):
        return value.cast("double")
    text = _stripped(value.cast("string"))
    return F.when(F.regexp_like(text, F.lit(NUMBER)), F.regexp_replace(text, "_", "").try_cast("double"))


def exact_score(a: Column, b: Column, kind: DataType) -> Column:
    """Numbers by value (not-a-number equals nothing), other values by their text in any case."""
    x, y = as_number(a, kind), as_number(b, kind)
    same = F.lower(render_text(a, kind)) == F.lower(render_text(b, kind))
    return F.when(x.isNotNull() & y.isNotNull(), (x == y) & ~F.isnan(x)).otherwise(same).cast("double")


def _raw_items(value: Column, kind: DataType) -> Column:
    if isinstance(kind, ArrayType):
        texts = F.transform(value, lambda x: render_text(x, kind.elementType))
    else:
        texts = F.transform(F.split(render_text(value, kind), r"\r\n|[\n\r]"), lambda x: _stripped(x))
    return F.filter(texts, lambda t: t != "")


def _sets_f1(a: Column, b: Column) -> Column:
    return once(F.struct(a.alias("x"), b.alias("y")), lambda t: f1(F.size(F.array_intersect(t["x"], t["y"])), F.size(t["x"]), F.size(t["y"])))


def set_score(a: Column, b: Column, kind: DataType) -> Column:
    of = lambda v: F.array_distinct(F.transform(_raw_items(v, kind), lambda t: F.array_join(tokens(t), " ")))
    return _sets_f1(of(a), of(b))


def ids_score(a: Column, b: Column, kind: DataType) -> Column:
    of = lambda v: identifiers(F.array_join(F.transform(_raw_items(v, kind), lambda t: F.regexp_replace(t, "[\r\n]+", " ")), "\n"))
    return _sets_f1(of(a), of(b))


def token_score(a: Column, b: Column, kind: DataType, words=text_f1) -> Column:
    """words: what compares the texts; token_f1 within lambdas."""
    return words(render_text(a, kind), render_text(b, kind))


def rouge_score(a: Column, b: Column, kind: DataType) -> Column:
    return rouge_l(render_text(a, kind), render_text(b, kind))


def present(score: Column, a: Column, b: Column, kind: DataType) -> tuple[Column, Column]:
    """(score, vacuous) with presence first."""
    return similarity.pair_score(score, render_text(a, kind), render_text(b, kind))


def leaf_score(a: Column, b: Column, kind: DataType, words=text_f1) -> Column:
    """Numbers exactly, texts by their tokens."""
    both = as_number(a, kind).isNotNull() & as_number(b, kind).isNotNull()
    return present(F.when(both, exact_score(a, b, kind)).otherwise(token_score(a, b, kind, words)), a, b, kind)[0]


def struct_score(a: Column, b: Column, kind: DataType, words=text_f1) -> Column:
    """The mean leaf score over the fields of a struct, or over the keys that either of two maps has."""
    if isinstance(kind, MapType):
        keys = F.array_union(F.map_keys(a), F.map_keys(b))
        scores = F.transform(keys, lambda k: leaf_score(F.try_element_at(a, k), F.try_element_at(b, k), kind.valueType, token_f1))
        return F.when(F.size(keys) == 0, 1.0).otherwise(F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.size(keys))
    if not isinstance(kind, StructType):
        return present(token_score(a, b, kind, words), a, b, kind)[0]
    if not kind.fields:
        return F.lit(1.0)
    return sum((leaf_score(a[f.name], b[f.name], f.dataType, words) for f in kind.fields), F.lit(0.0)) / len(kind.fields)


def _url_parts(text: Column) -> tuple[Column, Column, Column]:
    """Whether a text is a URL, its host and port, and its path with query and fragment, without closing slashes."""
    s = F.lower(_stripped(text))
    piece = lambda k: F.regexp_extract(s, r"^[^/?#]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", k)
    bare = lambda x: F.regexp_replace(x, "/+$", "")
    mark = lambda m, x: F.when(x != "", F.concat(F.lit(m), x)).otherwise("")
    fragment = F.when(piece(4) != "", F.concat(F.lit("#"), bare(piece(4)))).otherwise("")
    return F.contains(s, F.lit("://")), piece(1), F.concat(bare(piece(2)), mark("?", piece(3)), fragment)


def key_similarity(a: Column, b: Column) -> Column:
    """Of two item keys: for URLs 0.8 times the ratio of paths and 0.2 times that of hosts, or of hosts alone if neither has
    a path; for others the ratio of the texts."""
    (u, host, path), (v, other_host, other_path) = _url_parts(a), _url_parts(b)
    hosts = indel_ratio(host, other_host)
    return F.when(u & v, F.when((path == "") & (other_path == ""), hosts).otherwise(0.8 * indel_ratio(path, other_path) + 0.2 * hosts)).otherwise(indel_ratio(a, b))


def _ratio(x: str, y: str) -> float:
    return 1.0 if x == y else 2.0 * lcs(x, y) / (len(x) + len(y))


def url_parts(text: str) -> tuple[str, str] | None:
    """Host and path of a URL as _url_parts() has them; None for other texts."""
    s = text.strip().lower()
    if "://" not in s:
        return None
    rest, _, fragment = s.split("://", 1)[1].partition("#")
    rest, _, query = rest.partition("?")
    host, slash, path = rest.partition("/")
    return host, (slash + path).rstrip("/") + (f"?{query}" if query else "") + (f"#{fragment.rstrip('/')}" if fragment else "")


def plain_key_similarity(a: str, b: str) -> float:
    p, q = url_parts(a), url_parts(b)
    if not p or not q:
        return _ratio(a, b)
    hosts = _ratio(p[0], q[0])
    return hosts if not p[1] and not q[1] else 0.8 * _ratio(p[1], q[1]) + 0.2 * hosts


@pandas_udf(ArrayType(IntegerType()))
def _partners(a: pd.Series, b: pd.Series) -> pd.Series:
    """For each item of a, in order, the place of the free item of b whose key is nearest, the first one if equal, from
    ITEM_THRESHOLD on; else -1."""
    out = []
    for left, right in zip(a, b):
        left, right = [x or "" for x in (left if left is not None else [])], [x or "" for x in (right if right is not None else [])]
        free, places = dict(enumerate(right)), []
        for x in left:
            best, j = max(((plain_key_similarity(x, y), -j) for j, y in free.items()), default=(0.0, 0))
            places.append(-j if free and best >= ITEM_THRESHOLD else -1)
            free.pop(places[-1], None)
        out.append(places)
    return pd.Series(out, dtype="object")


def list_score(a: Column, b: Column, kind: ArrayType) -> Column:
    """Items paired by their first field, the sum of the pairs' struct scores over the longer list's length. Lists belong
    to one record, so pairing them is work within a row."""
    item = kind.elementType
    key = (lambda x: render_text(x[item.fields[0].name], item.fields[0].dataType)) if isinstance(item, StructType) else (lambda x: render_text(x, item))
    paired = F.arrays_zip(a.alias("x"), _partners(F.transform(a, key), F.transform(b, key)).alias("place"))
    total = F.aggregate(F.filter(paired, lambda p: p["place"] >= 0), F.lit(0.0), lambda s, p: s + struct_score(p["x"], F.get(b, p["place"]), item, token_f1))
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(longest > 0, total / longest).otherwise(1.0)


def structural_score(a: Column, b: Column, kind: DataType) -> Column:
    return list_score(a, b, kind) if isinstance(kind, ArrayType) else struct_score(a, b, kind)


@dataclass(frozen=True)
class Scorer:
    """kind: text scorers can be chosen; structural ones are run where a field calls for them."""

    name: str
    kind: str
    score: Callable[[Column, Column, DataType], Column] | None
    in_all: bool = True
    needs: str = ""

    @property
    def available(self) -> bool:
        return self.score is not None and (not self.needs or importlib.util.find_spec(self.needs) is not None)


def _missing(name: str) -> str:
    return f"the scorer {name!r} needs a model that isn't installed; register one with register()"


SCORERS: dict[str, Scorer] = {
    s.name: s
    for s in (
        Scorer("exact", "structural", exact_score), Scorer("set_f1", "structural", set_score), Scorer("set_f1_ids", "structural", ids_score),
        Scorer("structural", "structural", structural_score), Scorer("token_f1", "text", token_score), Scorer("rouge_l", "text", rouge_score),
        Scorer("bertscore", "text", None), Scorer("nli", "text", None, in_all=False),
    )
}
ALIASES = {"bert": "bertscore", "rouge": "rouge_l"}


def register(name: str, score: Callable[[Column, Column, DataType], Column], in_all: bool = True) -> None:
    """Give a text scorer, such as one with an embedding or an inference model, its function."""
    SCORERS[name] = Scorer(name, "text", score, in_all)


def chosen(spec: str | None) -> list[Scorer]:
    """Text scorers by name: None, '' and 'all' are all available ones that take part in all; unknown names are errors."""
    text = {n: s for n, s in SCORERS.items() if s.kind == "text"}
    if spec in (None, "", "all"):
        return [s for s in text.values() if s.available and s.in_all]
    out = []
    for part in spec.split(","):
        name = ALIASES.get(part.strip().lower(), part.strip().lower())
        if name not in text:
            raise ValueError(f"no text scorer {part.strip()!r}; there are {', '.join(sorted(text))}")
        if not text[name].available:
            raise RuntimeError(_missing(name))
        out.append(text[name])
    return out


def sentences(text: Column) -> Column:
    """Sentences and lines of a text, for scorers that compare sentence by sentence."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), _stripped), lambda s: s != "")


def field_of(rows: DataFrame, name: str) -> Column | None:
    """A column by its name or the alias Name for name; null if there is none."""
    if name in rows.columns:
        return F.col(f"`{name}`")
    if name.lower() == "name":
        other = "Name" if name == "name" else "name"
        return F.col(other) if other in rows.columns else None
    return None
