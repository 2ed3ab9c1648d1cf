"""Scores of matched pairs summed up: by field, by run, by model and target."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, NumericType, StructType

from siftwell.functions import scoring
from siftwell.operators import align, schema
from siftwell.plans.staging import ship_package, stage

#: Fields whose type doesn't tell how they are compared.
BY_NAME = {"references": "set_f1_ids"}


@dataclass(frozen=True)
class FieldPlan:
    """How a field is scored: text (by all chosen text scorers), structural, or one scorer's name."""

    name: str
    metric: str
    type: DataType


def inferred(kind: DataType, metadata: Mapping) -> str:
    """Fixed lists, numbers, truth values and mixed fields exactly; structs, maps and lists of structs by their parts."""
    if metadata.get("one_of") or metadata.get("mixed") or isinstance(kind, NumericType | BooleanType):
        return "exact"
    if isinstance(kind, StructType | MapType) or isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        return "structural"
    return "text"


def field_plans(kind: StructType, overrides: Mapping[str, str] | None = None) -> list[FieldPlan]:
    """Plans of the fields that an extractor produces: overrides before names before types; skip leaves a field out."""
    overrides = dict(overrides or {})
    valid = {*scoring.SCORERS, "skip"} - {"structural"}
    if unknown := sorted(set(overrides.values()) - valid):
        raise ValueError(f"unknown scorers {unknown}; there are {', '.join(sorted(valid))}")
    plans = [FieldPlan(f.name, overrides.get(f.name) or BY_NAME.get(f.name) or inferred(f.dataType, f.metadata), f.dataType) for f in schema.produced(kind)]
    return [p for p in plans if p.metric != "skip"]


def score_pairs(pairs: DataFrame, ext: DataFrame, base: DataFrame, plans: list[FieldPlan], scorers: list[scoring.Scorer], run: str = "run_id") -> DataFrame:
    """run, ext_idx, base_idx, field, metric, score, vacuous, filled_base, filled_ext: a row for each pair, field and scorer.

    Fields that a side lacks are empty there. A set scorer is always accompanied by the other one.
    """

    ship_package(pairs.sparkSession)

    def side(rows: DataFrame, idx: str, name: str) -> DataFrame:
        cells = [(c.cast(p.type) if (c := scoring.field_of(rows, p.name)) is not None else F.lit(None).cast(p.type)).alias(p.name) for p in plans]
        return rows.select(F.col(run), F.col("idx").alias(idx), F.struct(*cells).alias(name))

    met = pairs.select(run, "ext_idx", "base_idx").join(side(ext, "ext_idx", "e"), [run, "ext_idx"]).join(side(base, "base_idx", "b"), [run, "base_idx"])
    rows = []
    for p in plans:
        sets = ["set_f1", "set_f1_ids"]
        names = [s.name for s in scorers] if p.metric == "text" else sets if p.metric in sets else [p.metric]
        e, b = F.col("e")[p.name], F.col("b")[p.name]
        filled = lambda c, p=p: scoring.render_text(c, p.type) != ""
        for n in names:
            score, vacuous = scoring.present(scoring.SCORERS[n].score(e, b, p.type), e, b, p.type)
            rows.append(F.struct(F.lit(p.name).alias("field"), F.lit(n).alias("metric"), score.alias("score"), vacuous.alias("vacuous"), filled(b).alias("filled_base"), filled(e).alias("filled_ext")))
    return met.select(run, "ext_idx", "base_idx", F.explode(F.array(*rows)).alias("r")).select(run, "ext_idx", "base_idx", "r.*")


def unevaluated(base: DataFrame, kind: StructType, keys: tuple[str, ...] = ("run_id", "idx")) -> list[str]:
    """Columns of the truth that the record type doesn't have, in any case."""
    known = {f.name.lower() for f in kind.fields} | {"name", *keys}
    return sorted(c for c in base.columns if c.lower() not in known)


@dataclass(frozen=True)
class Evaluation:
    """pairs: the assignment; scores: long; fields: their summary; coverage: a row a run; mapping: a row a record.

    The assignment is worked out once; the others only where they are asked for.
    """

    pairs: DataFrame
    unevaluated: list[str]
    score: Callable[[], DataFrame]
    sides: tuple[DataFrame, DataFrame]
    run: str = "run_id"

    @cached_property
    def scores(self) -> DataFrame:
        return self.score()

    @cached_property
    def fields(self) -> DataFrame:
        return field_summary(self.scores)

    @cached_property
    def coverage(self) -> DataFrame:
        return covered(*self.sides, self.pairs, self.run)

    @cached_property
    def mapping(self) -> DataFrame:
        return align.mapping(*self.sides, self.pairs, self.run)


def evaluate_run(ext: DataFrame | None, base: DataFrame | None, kind: StructType, key_parts: tuple[str, ...] = (), metrics: str | None = "all", threshold: float = align.THRESHOLD, overrides: Mapping[str, str] | None = None, run: str = "run_id", cut_first: bool = False) -> Evaluation:
    """Extracted records against the truth: aligned, scored field by field, summed up. Both have run, idx and their fields.

    cut_first as in align.assign().
    """
    if base is None:
        raise ValueError("there is no truth to evaluate against; name one")
    if ext is None or not ext.limit(1).count():
        raise ValueError("there are no extracted records")
    name = lambda rows: c if (c := scoring.field_of(rows, "name")) is not None else F.lit(None).cast("string")
    sides = [align.keyed(rows.withColumn("__name", name(rows)), key_parts, "__name").drop("__name") for rows in (ext, base)]
    pairs = stage(align.assign(*sides, run, threshold, cut_first), "evaluate-pairs")
    plans, scorers = field_plans(kind, overrides), scoring.chosen(metrics)
    return Evaluation(pairs, unevaluated(base, kind, (run, "idx")), lambda: score_pairs(pairs, ext, base, plans, scorers, run), (sides[0], sides[1]), run)


def covered(ext: DataFrame, base: DataFrame, pairs: DataFrame, run: str = "run_id") -> DataFrame:
    """coverage() with the names that one side lacks, in order, and how many false positives are duplicates or inventions."""
    false, absent = align.unmatched(ext, base, pairs, run)
    names = lambda rows, c: rows.groupBy(run).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "norm_name"))), lambda x: x["norm_name"]).alias(c))  # noqa: E731  of one report
    matched = ext.join(pairs.select(run, F.col("ext_idx").alias("idx")), [run, "idx"], "left_semi").select(run, "norm_name", "parts").distinct().withColumn("twin", F.lit(True))
    kinds = false.join(matched, [run, "norm_name", "parts"], "left").groupBy(run).agg(F.count_if("twin").alias("duplicates"), F.count_if(F.col("twin").isNull()).alias("inventions"))
    out = coverage(pairs, ext, base, run).join(names(absent, "false_negatives"), run, "left").join(names(false, "false_positives"), run, "left").join(kinds, run, "left")
    none = F.array().cast("array<string>")
    return out.select(run, "matched", "extracted", "baseline", F.round("recall", 4).alias("recall"), F.round("precision", 4).alias("precision"), F.coalesce("false_negatives", none).alias("false_negatives"), F.coalesce("false_positives", none).alias("false_positives"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("duplicates", "inventions")])


#: Columns of a summary by metric: these first, others by name.
METRIC_ORDER = ("exact", "set_f1", "set_f1_ids", "structural")


def metric_order(metrics: list[str]) -> list[str]:
    return [m for m in METRIC_ORDER if m in metrics] + sorted(set(metrics) - set(METRIC_ORDER))


def field_summary(scores: DataFrame, keys: tuple[str, ...] = ("field", "metric")) -> DataFrame:
    """scores (field, metric, score, vacuous, filled_base, filled_ext) to means; vacuous pairs count only in mean, min and std."""
    real = F.when(~F.col("vacuous"), F.col("score"))
    return scores.groupBy(*keys).agg(
        F.round(F.avg("score"), 4).alias("mean"), F.round(F.avg(real), 4).alias("measured_mean"), F.count(real).alias("n_measured"), F.min("score").alias("min_score"), F.round(F.stddev_pop("score"), 4).alias("std"), F.count("*").alias("n"),
        F.count_if("vacuous").alias("vacuous_n"), F.round(F.avg(F.col("filled_base").cast("double")), 4).alias("fill_base"), F.round(F.avg(F.col("filled_ext").cast("double")), 4).alias("fill_ext"),
    )


def summary_pivot(summary: DataFrame, metrics: list[str]) -> DataFrame:
    """field by metric: measured means with three decimals, n/a where all pairs are vacuous, - where nothing is."""
    shown = F.when(F.col("n_measured") == 0, "n/a").otherwise(F.format_number("measured_mean", 3))
    out = summary.withColumn("shown", shown).groupBy("field").pivot("metric", metrics).agg(F.first("shown"))
    return out.fillna("-", metrics)


def worst_pairs(scores: DataFrame, k: int = 5) -> DataFrame:
    """The k pairs of each field with the lowest mean over metrics below 1, the earlier pair first if equal."""
    means = scores.groupBy("field", "run_id", "pair").agg(F.round(F.avg("score"), 6).alias("mean_score")).where("mean_score < 1")
    turn = F.row_number().over(W.partitionBy("field").orderBy("mean_score", "run_id", "pair"))
    return means.withColumn("place", turn).where(F.col("place") <= k)


def never_filled(summary: DataFrame) -> DataFrame:
    return summary.groupBy("field").agg(F.max("fill_base").alias("fill_base")).where("fill_base = 0").select("field")


def coverage(matched: DataFrame, extracted: DataFrame, truth: DataFrame, run: str = "run_id") -> DataFrame:
    """run: matched, extracted, baseline, recall and precision; runs without any match count too."""
    count = lambda df, name: df.groupBy(run).agg(F.count("*").alias(name))
    rows = count(truth, "baseline").join(count(extracted, "extracted"), run, "full").join(count(matched, "matched"), run, "left").fillna(0)
    return rows.select(run, "matched", "extracted", "baseline", F.try_divide("matched", "baseline").alias("recall"), F.try_divide("matched", "extracted").alias("precision"))


def exclusive_quantile(values: Column, k: int) -> Column:
    """The k-th quartile of a sorted array by the exclusive method: places k * (n + 1) / 4, ends extended."""
    n = F.size(values)
    place = F.least(F.greatest(F.floor(k * (n + 1) / 4), F.lit(1)), n - 1).cast("int")
    step = k * (n + 1) - place * 4
    low, high = F.element_at(values, place), F.element_at(values, place + 1)
    return F.when(n > 1, (low * (4 - step) + high * step) / 4).otherwise(F.element_at(values, 1))


def boxes(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """min, q1, med, q3, max and n of each group; groups hold the values of one model and target."""
    v = F.array_sort(F.collect_list(value))
    out = df.groupBy(*keys).agg(v.alias("v")).where(F.size("v") > 0)
    q = lambda k: F.round(exclusive_quantile(F.col("v"), k), 4)
    return out.select(*keys, F.round(F.element_at("v", 1), 4).alias("min"), q(1).alias("q1"), q(2).alias("med"), q(3).alias("q3"), F.round(F.element_at("v", -1), 4).alias("max"), F.size("v").alias("n"))


def experiment_levels(runs: DataFrame) -> DataFrame:
    """Means and deviations of done runs by (target, model) and by model, in one pass over grouping sets."""
    done = runs.where(F.col("status").isin("ok", "cached")).withColumn("absent", F.try_divide("false_negatives", "baseline_count"))
    rows = done.groupingSets([["target", "model"], ["model"]], "target", "model")
    mean = lambda c, name: (F.round(F.avg(c), 4).alias(f"{name}_mean"), F.round(F.stddev_pop(c), 4).alias(f"{name}_std"))
    return rows.agg(F.count("*").alias("n"), *mean("recall", "recall"), *mean("precision", "precision"), *mean("absent", "absent"), F.round(F.sum("cost"), 4).alias("cost"), F.round(F.avg("duration"), 4).alias("duration_mean"))


def model_ranking(levels: DataFrame) -> DataFrame:
    """Models by mean recall with their lead over the next; a row for each model."""
    order = W.orderBy(F.desc_nulls_last("recall_mean"), "model")
    return levels.where("target IS NULL").select("model", "recall_mean", F.row_number().over(order).alias("place"), F.round(F.col("recall_mean") - F.lead("recall_mean").over(order), 4).alias("ahead"))


def totals(runs: DataFrame) -> DataFrame:
    """One row: planned, done, failed and skipped runs, seconds and cost over all."""
    s = F.col("status")
    return runs.agg(F.count("*").alias("planned"), F.count_if(s.isin("ok", "cached")).alias("done"), F.count_if(s.isin("failed", "fatal")).alias("failed"), F.count_if(s == "skipped").alias("skipped"), F.round(F.sum("duration"), 2).alias("active_seconds"), F.round(F.sum("cost"), 4).alias("cost_usd"))


def categories(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """Shares of high, moderate, slight, divergent and absent pairs by model and metric; a pair's score is its mean over fields."""
    done = runs.where(F.col("status").isin("ok", "cached"))
    scores = pairs.where(~F.col("vacuous")).groupBy("run_id", "pair", "metric").agg(F.avg("score").alias("score")).join(done.select("run_id", "model"), "run_id")
    absent = done.groupBy("model").agg(F.avg(F.try_divide("false_negatives", "baseline_count")).alias("absent"))
    s = F.round(F.col("score"), 9)
    share = lambda c, name: F.round(F.avg(c.cast("double")) * (1 - F.first("absent")), 4).alias(name)
    return scores.join(absent, "model").groupBy("model", "metric").agg(share(s >= 0.9, "high"), share((s >= 0.8) & (s < 0.9), "moderate"), share((s >= 0.7) & (s < 0.8), "slight"), share(s < 0.7, "divergent"), F.round(F.first("absent"), 4).alias("absent"))


def omissions(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """model, field: mean over runs of how much less the extraction fills than the truth, not below 0."""
    done = runs.where(F.col("status").isin("ok", "cached")).select("run_id", "model")
    fills = pairs.groupBy("run_id", "field").agg(F.avg(F.col("filled_base").cast("double")).alias("b"), F.avg(F.col("filled_ext").cast("double")).alias("e"))
    return fills.join(done, "run_id").groupBy("model", "field").agg(F.round(F.avg(F.greatest(F.lit(0.0), F.col("b") - F.col("e"))) + 1e-9, 4).alias("gap"))


def plan_runs(models: DataFrame, reports: DataFrame, n_runs: int, done: DataFrame) -> DataFrame:
    """model, report, run, status: the grid, with cached for what is done. Models and runs are few."""
    grid = reports.join(F.broadcast(models.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(n_runs))))))
    return grid.join(done.select("model", "report", "run").distinct().withColumn("cached", F.lit(True)), ["model", "report", "run"], "left").withColumn("status", F.when(F.col("cached"), "cached").otherwise("planned")).drop("cached")


def field_means(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """metric, target, field, model: mean and deviation over done runs of the run's measured mean, and how many runs measured it.

    Every combination of the metrics of a field with the targets and models of done runs has a row, with no mean where no run
    measured it. Fields, metrics, targets and models are few; what is made of pairs is summed up by run first.
    """
    done = runs.where(F.col("status").isin("ok", "cached")).select("run_id", "target", "model")
    measured = pairs.where(~F.col("vacuous")).groupBy("run_id", "field", "metric").agg(F.avg("score").alias("mean"))
    each = measured.join(done, "run_id").groupBy("metric", "target", "field", "model").agg(F.round(F.avg("mean"), 4).alias("mean"), F.round(F.stddev_pop("mean"), 4).alias("std"), F.count("*").alias("n"))
    kinds = pairs.join(done.select("run_id"), "run_id", "left_semi").select("field", "metric").distinct()
    grid = kinds.join(done.select("target").distinct()).join(done.select("model").distinct())
    return grid.join(each, ["metric", "target", "field", "model"], "left").fillna(0, ["n"])


def pooled_boxes(runs: DataFrame, value: str) -> DataFrame:
    """boxes() of a value by model over all targets; a model's runs are few."""
    return boxes(runs.where(F.col("status").isin("ok", "cached") & F.col(value).isNotNull()), value, "model")
