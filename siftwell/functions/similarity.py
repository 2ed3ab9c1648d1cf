"""Scores of how alike two values are: native where Catalyst can say it, Arrow UDFs for the subsequence measures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

from siftwell.functions.text import once, tokens


def f1(common: Column, left: Column, right: Column) -> Column:
    """Twice the common part over both sizes; 0 if nothing is common."""
    return F.coalesce(F.try_divide(2.0 * common, left + right), F.lit(0.0))


def items(value: Column) -> Column:
    """The distinct normalised lines of a text."""
    return F.array_distinct(F.transform(F.split(value, "\n"), lambda x: F.array_join(tokens(x), " ")))


def set_f1(a: Column, b: Column) -> Column:
    return f1(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of the multisets of tokens, for short texts within other native expressions; text_f1() serves whole columns."""
    return once(F.struct(tokens(a).alias("x"), tokens(b).alias("y")), lambda t: _multisets_f1(t["x"], t["y"]))


def _multisets_f1(x: Column, y: Column) -> Column:
    none = F.lit(0).cast("long")
    start = F.struct(F.lit("").alias("word"), none.alias("left"), none.alias("right"), none.alias("common"))

    def add(acc: Column, t: Column) -> Column:
        same = acc["word"] == t["word"]
        return F.struct(
            t["word"].alias("word"), (F.when(same, acc["left"]).otherwise(none) + F.when(t["mine"], 1).otherwise(0)).alias("left"), (F.when(same, acc["right"]).otherwise(none) + F.when(t["mine"], 0).otherwise(1)).alias("right"),
            F.when(same, acc["common"]).otherwise(acc["common"] + F.least(acc["left"], acc["right"])).alias("common"),
        )

    # Sorted, equal tokens of both sides stand together: one pass counts them.
    marked = lambda side, mine: F.transform(side, lambda t: F.struct(t.alias("word"), F.lit(mine).alias("mine")))
    both = F.sort_array(F.concat(marked(x, True), marked(y, False)))
    common = F.aggregate(both, start, add, lambda acc: acc["common"] + F.least(acc["left"], acc["right"]))
    return f1(common, F.size(x), F.size(y))


_WORD_BYTES = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))


def _words(text: str) -> list[str]:
    """The runs of a-z and 0-9: every other byte, all of those of longer UTF-8 sequences too, becomes a blank."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).decode("ascii").split()


@pandas_udf(DoubleType())
def _lower_f1(a: pd.Series, b: pd.Series) -> pd.Series:
    from collections import Counter

    out = []
    for x, y in zip(a, b):
        p, q = _words(x or ""), _words(y or "")
        if p and q:
            left, right = Counter(p), Counter(q)
            if len(left) > len(right):
                left, right = right, left
            common = sum(min(n, right[w]) for w, n in left.items() if w in right)
            out.append(2.0 * common / (len(p) + len(q)))
        else:
            out.append(0.0)
    return pd.Series(out, dtype="float64")


def text_f1(a: Column, b: Column) -> Column:
    """token_f1() in one pass over both texts; not for use within lambdas of native expressions."""
    return _lower_f1(F.lower(a), F.lower(b))


def exact(a: Column, b: Column) -> Column:
    """Numbers by value, other texts in any case."""
    x, y = F.trim(a).try_cast("double"), F.trim(b).try_cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(F.lower(F.trim(a)) == F.lower(F.trim(b))).cast("double")


def _item_identifiers(item: Column) -> Column:
    """Identifiers of one lower-case reference item; a leading label counts for bare numbers of its comma list too."""

    def each(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(item, F.lit(pattern), F.lit(0)), lambda x: F.concat(F.lit(kind), F.array_join(F.regexp_extract_all(x, F.lit(r"\d+"), F.lit(0)), "-")))

    parts = F.filter(F.transform(F.split(item, ","), lambda x: F.trim(x)), lambda x: x != "")
    label = F.regexp_extract(item, r"^\s*(cve|cwe|bid)\b", 1)
    bare = F.when(label != "", F.transform(F.filter(parts, lambda x: F.regexp_like(x, F.lit(r"^\d{1,7}$"))), lambda x: F.concat(label, F.lit("-"), x))).otherwise(F.array().cast("array<string>"))
    found = F.concat(
        each("cve-", r"cve[-\s:]*\d{4}[-\s]\d{3,7}"), each("cwe-", r"cwe[-\s:]*\d+"), each("bid-", r"bid[-\s:]*\d+"),
        F.transform(F.regexp_extract_all(item, F.lit(r"\b\d{4}-(a|api)\d{1,2}\b"), F.lit(0)), lambda x: F.concat(F.lit("owasp-"), x)),
        F.transform(F.regexp_extract_all(item, F.lit(r"https?://[^\s,'\"]+"), F.lit(0)), lambda x: F.regexp_replace(x, "[/.]+$", "")), bare)
    # Without any: the comma parts, each with the first part's first word.
    word = F.coalesce(F.regexp_extract(F.try_element_at(parts, F.lit(1)), r"^(\S+)", 1), F.lit(""))
    named = F.transform(parts, lambda x, i: F.when((i == 0) | F.startswith(x, word), x).otherwise(F.concat(word, F.lit(" "), x)))
    plain = F.filter(F.transform(named, lambda x: F.array_join(tokens(x), " ")), lambda x: x != "")
    return F.when(F.size(found) > 0, found).otherwise(plain)


def identifiers(text: Column) -> Column:
    """The distinct CVE, CWE, BID, OWASP and URL identifiers of the lines of a text; of a line without any, its words."""
    return F.array_distinct(F.flatten(F.transform(F.split(F.lower(text), "\n"), _item_identifiers)))


def set_f1_ids(a: Column, b: Column) -> Column:
    return once(F.struct(identifiers(a).alias("x"), identifiers(b).alias("y")), lambda t: f1(F.size(F.array_intersect(t["x"], t["y"])), F.size(t["x"]), F.size(t["y"])))


def pair_score(score: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """(score, vacuous): 1 and true if both sides are empty, 0 and false if one is."""
    x, y = F.coalesce(F.trim(a), F.lit("")) == "", F.coalesce(F.trim(b), F.lit("")) == ""
    return F.when(x & y, 1.0).when(x | y, 0.0).otherwise(score), x & y


def _places(b, common: set) -> dict:
    """For each symbol, the places of b that hold it, as bits."""
    places: dict = {}
    if isinstance(b, str) and len(b) > 12 * len(common):  # many places each: found by comparisons of many symbols at once
        try:
            codes = np.frombuffer(b.encode("latin-1"), "u1")
        except UnicodeEncodeError:
            codes = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), "<u4")
        symbols, size, many = list(common), (len(b) + 7) // 8, max(1, 4_000_000 // len(b))
        for at in range(0, len(symbols), many):
            part = symbols[at : at + many]
            same = codes == np.array([ord(x) for x in part], codes.dtype)[:, None]
            bits = np.packbits(same, axis=1, bitorder="little").tobytes()
            for k, x in enumerate(part):
                places[x] = int.from_bytes(bits[k * size : (k + 1) * size], "little")
        return places
    for i, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << i
    return places


def lcs(a, b) -> int:
    """Length of the longest common subsequence: a step for each symbol of the shorter side, over all places of the longer.

    Common ends are set aside first, and so are symbols that only one side has.
    """
    if len(a) > len(b):
        a, b = b, a
    start, end = 0, 0
    while start < len(a) and a[start] == b[start]:
        start += 1
    while end < len(a) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    common = set(a) & set(b)
    if not isinstance(b, str):
        b = [x for x in b if x in common]
    places = _places(b, common)
    steps = [places[x] for x in a if x in common]
    row = full = (1 << len(b)) - 1
    for at in range(0, len(steps), 256):
        for place in steps[at : at + 256]:
            match = row & place
            row = (row + match) | (row ^ match)
        row &= full  # a step carries at most one bit above the top
    return start + end + len(b) - row.bit_count()


@pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * LCS / (lengths) of characters; 1 for two empty texts."""
    return pd.Series([1.0 if x == y else 2.0 * lcs(x, y) / (len(x) + len(y)) for x, y in zip(a.fillna(""), b.fillna(""))], dtype="float64")


@pandas_udf(DoubleType())
def rouge_l(a: pd.Series, b: pd.Series) -> pd.Series:
    """F1 of the LCS of tokens."""
    out = []
    for x, y in zip(a.fillna(""), b.fillna("")):
        p, q = _words(x.lower()), _words(y.lower())
        n = lcs(p, q) if p and q else 0
        out.append(2.0 * n / (len(p) + len(q)) if n else 0.0)
    return pd.Series(out, dtype="float64")


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Catalyst lacks."""
    import unicodedata

    return text.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def ratio_bound(a: Column, b: Column) -> Column:
    """What indel_ratio can be at most, by the lengths alone."""
    x, y = F.length(a), F.length(b)
    return F.when(x + y > 0, 2.0 * F.least(x, y) / (x + y)).otherwise(1.0)
