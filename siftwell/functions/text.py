"""Text cleaning and tokens as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Page furniture, repaired byte sequences, glyph numbers of the PDF text layer.
FOOTER = r"Page \d+ of \d+"
CONTINUED = r"(?i)^.*(?:\.\s?\.\s?\.\s?)?continue[sd] (?:on next|from previous) page.*$"
EXPORT_FOOTER = r"Web Application Scanning Detailed Scan Export:[^\n]*"
REPAIRS = {"ÔåÆ": "->", "ÔÇÖ": "'", "ÔÇ£": '"', "ÔÇØ": '"'}
GLYPHS = {16: '"', 17: '"', 27: "ff", 28: "fi", 29: "fl", 30: "ffi", 31: "ffl"}
CONTROL = r"[\x00-\x08\x0b-\x1f\x7f]"


def once(value: Column, use) -> Column:
    """use(value) with the value worked out once a row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def keep_line(line: Column) -> Column:
    """False for page footers and continuation notes."""
    # Plain searches come before the patterns, which few lines then need.
    footer = F.contains(line, F.lit("Page ")) & F.regexp_like(line, F.lit(FOOTER))
    continued = F.contains(F.lower(line), F.lit(" page")) & F.regexp_like(F.regexp_replace(line, r"^\s+|\s+$", ""), F.lit(CONTINUED))
    return ~footer & ~continued


def clean_line(line: Column) -> Column:
    """Tabs to four spaces, repaired characters, runs of spaces to one."""
    out = F.replace(line, F.lit("\t"), F.lit("    "))
    repaired = out
    for bad, good in REPAIRS.items():
        repaired = F.replace(repaired, F.lit(bad), F.lit(good))
    out = F.when(F.contains(out, F.lit("Ô")), repaired).otherwise(out)
    return F.when(F.contains(out, F.lit("  ")), F.regexp_replace(out, " {2,}", " ")).otherwise(out)


def clean_page(page: Column) -> Column:
    """A page without furniture, its end stripped and closed by one line break."""
    lines = F.transform(F.filter(F.split(page, "\n", -1), keep_line), clean_line)
    return F.concat(F.regexp_replace(F.array_join(lines, "\n"), r"\s+$", ""), F.lit("\n"))


def clean_text(text: Column, compose=None) -> Column:
    """Glyph numbers written out, control characters dropped, words rejoined that a line break split.

    compose: what brings characters to their compatible form (similarity.nfkc), where that is wanted.
    """
    out = text
    for number, written in GLYPHS.items():
        out = F.replace(out, F.lit(chr(number)), F.lit(written))
    out = F.regexp_replace(out, CONTROL, "")
    out = compose(out) if compose else out
    out = F.regexp_replace(out, r"\n[ \t]*\(cid:44\)→", "")
    for number, written in GLYPHS.items():
        out = F.replace(out, F.lit(f"(cid:{number})"), F.lit(written))
    out = F.regexp_replace(out, r"\(cid:\d+\)", "")
    return F.regexp_replace(F.regexp_replace(out, r"(?U)(\w)-\n[ \t]*(\w)", "$1$2"), EXPORT_FOOTER, "")


def normal_name(name: Column) -> Column:
    """Lower case, outer blanks off, inner blanks to one; null is empty."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def slug(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""), 1, 80)


def unfenced(answer: Column) -> Column:
    """An extractor's answer without thoughts and code fences."""
    out = F.regexp_replace(answer, r"(?is)<think>.*?</think>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?s)^\s*```[a-zA-Z]*\s*", ""), r"\s*```\s*$", ""))


def unix_lines(text: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"^\s+|\s+$", ""), F.lit(""))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def n_tokens(text: Column) -> Column:
    """Tokens by length, for budgets: 3.5 characters each."""
    return F.floor(F.length(text) / 3.5).cast("int")
