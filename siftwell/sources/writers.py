"""DataFrames to files, by Spark's writers; single documents are one row of text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators.exports import flat_cells


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def json_array(df: DataFrame, path: str, order: str = "seq") -> None:
    """One JSON array in one part file; it gathers the rows of one run's results."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != order]), {"ignoreNullFields": "false"}).alias("j")))), lambda x: x["j"])
    df.agg(F.concat(F.lit("[\n"), F.array_join(rows, ",\n"), F.lit("\n]")).alias("value")).write.mode("overwrite").text(path)


def csv(df: DataFrame, path: str) -> None:
    flat_cells(df).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def union_columns(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Rows of several record types with the columns of all."""
    for df in more:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def document(df: DataFrame, path: str) -> None:
    df.toDF("value").write.mode("overwrite").text(path)


def run_name(stem: Column, model: Column, at: Column) -> Column:
    """<UTC stamp>_<report>_<model>."""
    plain = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_")
    return F.concat_ws("_", F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), plain(stem), plain(model))


def markdown(summary: DataFrame, metrics: list[str]) -> str:
    """The table of fields and metrics; a row for each field, so it is small whatever the pairs."""
    rows = [r.asDict() for r in summary.orderBy("field").collect()]
    lines = ["| field | " + " | ".join(metrics) + " |", "| --- |" + " --- |" * len(metrics)]
    return "\n".join(lines + ["| " + " | ".join([r["field"], *[str(r[m]) for m in metrics]]) + " |" for r in rows])


def html(levels: DataFrame) -> str:
    """A page with the experiment's levels as a table and as data."""
    rows = [r.asDict() for r in levels.orderBy("model", F.col("target").asc_nulls_first()).collect()]
    head = "".join(f"<th>{c}</th>" for c in levels.columns)
    body = "".join("<tr>" + "".join(f"<td>{'all' if v is None else v}</td>" for v in r.values()) + "</tr>" for r in rows)
    return f"<!doctype html><meta charset='utf-8'><title>Experiment</title><table><tr>{head}</tr>{body}</table><script type='application/json' id='data'>{json.dumps(rows, default=str)}</script>"
