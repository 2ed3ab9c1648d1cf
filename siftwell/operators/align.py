"""Extracted records matched with ground truth: similarity of keys and names, then the best assignment of a run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.functions.similarity import indel_ratio, ratio_bound
from siftwell.functions.text import normal_name
from siftwell.plans.staging import ship_package

THRESHOLD, CONFLICT, WILDCARD = 0.7, 0.9, 0.3


def key_part(value: Column, port: bool = False) -> Column:
    """A part of a key: * for what is missing, whole numbers without fraction; a port that is no number is general or *."""
    text = F.trim(value.cast("string"))
    number = F.regexp_replace(text, r"\.0+$", "")
    out = F.when(text.isNull() | F.lower(text).isin("", "nan", "none"), "*").otherwise(F.lower(number))
    if port:
        digits = F.regexp_replace(out, "[,.]", "")
        out = F.when(out == "*", out).when(F.regexp_like(digits, F.lit(r"^\d+$")), digits).when(digits == "general", digits).otherwise("*")
    return out


def keyed(records: DataFrame, parts: tuple[str, ...], name: str = "name") -> DataFrame:
    """records with norm_name and parts, an array."""
    return records.withColumn("norm_name", normal_name(F.col(name))).withColumn("parts", F.array(*[key_part(F.col(p), p == "port") for p in parts]))


def compatible(a: Column, b: Column) -> Column:
    return F.forall(F.zip_with(a, b, lambda x, y: (x == "*") | (y == "*") | (x == y)), lambda ok: ok)


def key_score(name: Column, parts: Column, other: Column) -> Column:
    """Mean over the name and the parts of two compatible keys: 1 for what is known on both sides, 0.3 for wildcards."""
    each = F.zip_with(parts, other, lambda x, y: F.when((x == "*") | (y == "*"), WILDCARD).when(x == y, 1.0).otherwise(0.0))
    return F.aggregate(each, F.when(name == "*", WILDCARD).otherwise(1.0), lambda s, x: s + x) / (F.size(parts) + 1)


def same_name_similarity(name: Column, parts: Column, other: Column) -> Column:
    """Of two records with one name. Names that aren't empty are alike by 1, empty ones by 0: unnamed records count by
    their keys alone."""
    alike = F.when(name == "", 0.0).otherwise(1.0)
    return F.when(compatible(parts, other), F.greatest(key_score(name, parts, other), alike)).otherwise(CONFLICT * alike)


def pair_similarity(ext: DataFrame, base: DataFrame, run: str = "run_id", least: float = THRESHOLD) -> DataFrame:
    """Pairs of a run that can reach `least`, with their similarity.

    ext and base: run_id, idx, norm_name, parts. Equal names: the larger of the keys' score and the names' likeness if the
    parts agree (* agrees with all), else 0.9 times the latter. Other names: 0.9 times their ratio, so pairs whose lengths
    alone keep them below never meet the ratio. Pairs arise within a run only; equal names meet by an equi-join.
    """
    ship_package(ext.sparkSession)
    e = ext.select(F.col(run), F.col("idx").alias("ext_idx"), F.col("norm_name").alias("ext_name"), F.col("parts").alias("ext_parts"))
    b = base.select(F.col(run), F.col("idx").alias("base_idx"), F.col("norm_name").alias("base_name"), F.col("parts").alias("base_parts"))
    same = e.join(b.withColumn("ext_name", F.col("base_name")), [run, "ext_name"]).withColumn("similarity", same_name_similarity(F.col("ext_name"), F.col("ext_parts"), F.col("base_parts")))
    some = F.when((F.col("ext_name") == "") | (F.col("base_name") == ""), F.lit(0.0)).otherwise(CONFLICT * ratio_bound(F.col("ext_name"), F.col("base_name")))
    other = e.join(b, run).where((F.col("ext_name") != F.col("base_name")) & (some >= least))
    other = other.withColumn("similarity", F.when((F.col("ext_name") == "") | (F.col("base_name") == ""), 0.0).otherwise(CONFLICT * indel_ratio("ext_name", "base_name")))
    cols = [run, "ext_idx", "base_idx", "similarity"]
    return same.select(*cols).unionByName(other.select(*cols))


def best_assignment(cost) -> list[tuple[int, int]]:
    """Rows to columns at least cost (no more rows than columns), by shortest augmenting paths with potentials.

    Rows first take a free column at their least cost; the others outbid their owners by what the second column costs
    more, as long as that helps; only what is left then searches a path.
    """
    cost = np.asarray(cost, dtype="float64")
    n, m = len(cost), cost.shape[1] if cost.ndim == 2 else 0
    if not n or not m:
        return []
    u, v, column, owner, free = cost.min(axis=1), np.zeros(m), np.full(n, -1), np.full(m, -1), np.ones(m, dtype=bool)
    waiting, places = [], np.arange(m)
    for row in range(n):
        ties = (cost[row] == u[row]) & free
        col = int(ties.argmax())
        if ties[col]:
            column[row], owner[col], free[col] = col, row, False
        else:
            waiting.append(row)
    for _ in range(2):
        turns, waiting, later = 4 * len(waiting), waiting[::-1], []
        while waiting and turns:
            turns -= 1
            row = waiting.pop()
            c = cost[row] - v
            col = int(c.argmin())
            low, c[col] = c[col], np.inf
            second = int(c.argmin())
            u[row] = c[second] if m > 1 else low
            if low < u[row]:
                v[col] -= u[row] - low
            elif not free[col] and m > 1:
                col = second
            other = int(owner[col])
            owner[col], column[row], free[col] = row, col, False
            if other >= 0:
                column[other] = -1
                (waiting if low < u[row] else later).append(other)
        waiting = waiting[::-1] + later
    for start in waiting:
        u[start] = (cost[start] - v).min()
        least, way, used = np.full(m, np.inf), np.zeros(m, dtype="int64"), np.zeros(m, dtype=bool)
        rows, low = [start], 0.0
        while True:  # columns that are equally near are passed together
            if len(rows) == 1:
                c, by = cost[rows[0]] - v + (low - u[rows[0]]), rows[0]
            else:
                c = cost[rows] - u[rows][:, None]
                which = c.argmin(axis=0)
                c, by = c[which, places] - v + low, np.asarray(rows)[which]
            nearer = (c < least) & ~used
            np.copyto(least, c, where=nearer)
            np.copyto(way, by, where=nearer)
            open_ = np.where(used, np.inf, least)
            low = open_.min()
            near = open_ == low
            ends = near & free
            end = int(ends.argmax())
            if ends[end]:
                break
            used |= near
            rows = owner[near]
        u[start] += low
        u[owner[used]] += low - least[used]
        v[used] -= low - least[used]
        free[end] = False
        while True:
            row = int(way[end])
            owner[end] = row
            column[row], end = end, int(column[row])
            if row == start:
                break
    return [(i, int(j)) for i, j in enumerate(column)]


def common_lengths(names: list[str], others: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each name and each other.

    The others lie side by side in one word, each with a spare bit that takes its carry, so a step serves all of them.
    """
    places: dict[str, int] = {}
    starts, at, full = [], 0, 0
    for other in others:
        starts.append(at)
        for i, x in enumerate(other):
            places[x] = places.get(x, 0) | 1 << at + i
        full |= (1 << len(other)) - 1 << at
        at += len(other) + 1
    lengths, known = np.array([len(x) for x in others], dtype="int64"), {}
    for name in set(names):
        row = full
        for x in name:
            match = row & places.get(x, 0)
            row = ((row + match) | (row - match)) & full
        bits = np.unpackbits(np.frombuffer(row.to_bytes((at + 7) // 8, "little"), dtype="uint8"), bitorder="little")
        known[name] = lengths - np.add.reduceat(bits[:at].astype("int64"), starts)
    return np.array([known[x] for x in names])


class Lengths:
    """common_lengths() of distinct names, remembered for names that come again; at most `most` names are held."""

    def __init__(self, most: int = 1024):
        self.most, self.places, self.known = most, {}, np.full((most, most), -1, dtype="int32")

    def of(self, names: list[str], others: list[str]) -> np.ndarray:
        if len({*self.places, *names, *others}) > self.most:
            self.places, self.known[:] = {}, -1
            if len({*names, *others}) > self.most:
                return common_lengths(names, others)
        rows, cols = ([self.places.setdefault(x, len(self.places)) for x in side] for side in (names, others))
        got = self.known[np.ix_(rows, cols)]
        new = np.flatnonzero((got < 0).any(axis=1))
        if len(new):
            got[new] = common_lengths([names[i] for i in new], others)
            self.known[np.ix_([rows[i] for i in new], cols)] = got[new]
        return got


def same_similarity(name: str, parts: list[str], other: list[str]) -> float:
    """same_name_similarity() of one cell."""
    alike = 1.0 if name else 0.0
    if all(x == y or x == "*" or y == "*" for x, y in zip(parts, other)):
        known = sum(WILDCARD if x == "*" or y == "*" else 1.0 for x, y in zip(parts, other)) + (WILDCARD if name == "*" else 1.0)
        return max(known / (len(parts) + 1), alike)
    return CONFLICT * alike


def similarities(names: list[str], parts: list, others: list[str], other_parts: list, lengths=common_lengths) -> np.ndarray:
    """The whole matrix of a run, as pair_similarity() has its cells."""
    some, more = {x: i for i, x in enumerate(dict.fromkeys(names))}, {x: i for i, x in enumerate(dict.fromkeys(others))}
    sizes = np.array([len(x) for x in some])[:, None] + np.array([len(x) for x in more])[None, :]
    matrix = CONFLICT * (2.0 * lengths(list(some), list(more)) / np.maximum(sizes, 1))
    matrix = matrix[np.ix_([some[x] for x in names], [more[x] for x in others])]
    places: dict[str, list[int]] = {}
    for j, name in enumerate(others):
        places.setdefault(name, []).append(j)
    for i, name in enumerate(names):
        for j in places.get(name, ()):
            matrix[i, j] = same_similarity(name, parts[i], other_parts[j])
    return matrix


def nearest_by_name(names: list[str], parts: list, others: list[str], other_parts: list) -> list[tuple[int, int, float]] | None:
    """The assignment where names alone settle it: each name's nearest namesake is the only nearest and no one else's.

    A namesake is nearer than any other name (0.9 at least against less than 0.9; unnamed: more than 0 against 0), so no
    other pair needs a look. None where that doesn't hold.
    """
    places: dict[str, list[int]] = {}
    for j, name in enumerate(others):
        places.setdefault(name, []).append(j)
    out, taken = [], set()
    for i, name in enumerate(names):
        near, best, alone = -1, 0.0, True
        for j in places.get(name, ()):
            s = same_similarity(name, parts[i], other_parts[j])
            if s > best:
                near, best, alone = j, s, True
            elif s == best:
                alone = False
        if near < 0 or not alone or near in taken:
            return None
        taken.add(near)
        out.append((i, near, best))
    return out


def best_pairs(names: list[str], parts: list, others: list[str], other_parts: list, lengths=common_lengths, least: float = 0.0) -> list[tuple[int, int, float]]:
    """(place, other place, similarity) of a run's best assignment; pairs below `least` count for nothing in it."""
    if len(names) > len(others):
        return sorted((i, j, s) for j, i, s in best_pairs(others, other_parts, names, parts, lengths, least))
    if not names:
        return []
    found = nearest_by_name(names, parts, others, other_parts)
    if found is not None:
        return found
    matrix = similarities(names, parts, others, other_parts, lengths)
    if least <= 0:
        return [(i, j, float(matrix[i, j])) for i, j in best_assignment(-matrix)]
    matrix = np.where(matrix >= least, matrix, 0.0)
    rows, cols = np.flatnonzero(matrix.any(axis=1)), np.flatnonzero(matrix.any(axis=0))
    cost = -matrix[np.ix_(rows, cols)]
    pairs = best_assignment(cost) if len(rows) <= len(cols) else [(i, j) for j, i in best_assignment(cost.T)]
    return sorted((int(rows[i]), int(cols[j]), float(-cost[i, j])) for i, j in pairs)


def assign(ext: DataFrame, base: DataFrame, run: str = "run_id", threshold: float = THRESHOLD, cut_first: bool = False) -> DataFrame:
    """run, ext_idx, base_idx, similarity: the best assignment of each run's whole matrix, cut at the threshold afterwards.

    cut_first: pairs below the threshold count for nothing in the assignment, so that no pair above it gives way to them.

    A run holds the findings of one report (hundreds), so a run is worked on as a whole; runs are spread over the cluster,
    and a task passes through its runs one after the other, holding one run and one batch of rows.
    """
    ship_package(ext.sparkSession)
    side = lambda df, k: df.select(F.col(run).alias("run"), F.lit(k).alias("side"), F.col("idx").alias("idx"), F.col("norm_name").alias("norm_name"), F.col("parts").alias("parts"))
    rows = side(ext, 0).unionByName(side(base, 1)).where("run IS NOT NULL").repartition("run").sortWithinPartitions("run", "side", "idx")

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(5)]  # rows of the run that may go on in the next batch
        kind, lengths = None, Lengths()
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.schema.field(0).type
            rows = [a + b for a, b in zip(held, (c.to_pylist() for c in batch.columns))]
            runs = rows[0]
            starts = [0, *(i for i in range(1, len(runs)) if runs[i] != runs[i - 1])]
            yield solved(rows, list(zip(starts, starts[1:])), kind, lengths)
            held = [c[starts[-1] :] for c in rows]
        if held[0]:
            yield solved(held, [(0, len(held[0]))], kind, lengths)

    def solved(rows: list[list], spans: list[tuple[int, int]], kind: pa.DataType, lengths: Lengths) -> pa.RecordBatch:
        runs, sides, idx, names, parts = rows
        out: list[list] = [[], [], [], []]
        for low, high in spans:
            middle = low + sides[low:high].count(0)
            for i, j, s in best_pairs(names[low:middle], parts[low:middle], names[middle:high], parts[middle:high], lengths.of, threshold if cut_first else 0.0):
                if s >= threshold:
                    for c, x in zip(out, (runs[low], idx[low + i], idx[middle + j], s)):
                        c.append(x)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (kind, pa.int64(), pa.int64(), pa.float64()))], names=[run, "ext_idx", "base_idx", "similarity"])

    kind = dict(ext.dtypes)[run]
    return rows.mapInArrow(passed, f"{run} {kind}, ext_idx long, base_idx long, similarity double")


def unmatched(ext: DataFrame, base: DataFrame, pairs: DataFrame, run: str = "run_id") -> tuple[DataFrame, DataFrame]:
    """(extracted without truth, truth without extraction)."""
    return (
        ext.join(pairs.select(run, F.col("ext_idx").alias("idx")), [run, "idx"], "left_anti"),
        base.join(pairs.select(run, F.col("base_idx").alias("idx")), [run, "idx"], "left_anti"),
    )


def mapping(ext: DataFrame, base: DataFrame, pairs: DataFrame, run: str = "run_id") -> DataFrame:
    """A row for each extracted record: its name, the truth that it was matched with, their similarity, MATCHED or UNMATCHED."""
    rows = ext.select(run, F.col("idx").alias("ext_idx"), F.col("norm_name").alias("ext_name")).join(pairs, [run, "ext_idx"], "left")
    rows = rows.join(base.select(run, F.col("idx").alias("base_idx"), F.col("norm_name").alias("base_name")), [run, "base_idx"], "left")
    status = F.when(F.col("base_idx").isNull(), "UNMATCHED").otherwise("MATCHED")
    return rows.select(run, "ext_idx", "ext_name", "base_idx", "base_name", F.round(F.coalesce("similarity", F.lit(0.0)), 4).alias("similarity"), status.alias("status"))


def false_positive_kinds(false: DataFrame, ext: DataFrame, base: DataFrame, pairs: DataFrame, run: str = "run_id") -> DataFrame:
    """duplicate where a matched record has the same key, else invention; with the nearest truth, the last one if equal,
    however far it is. Only the records without truth meet a run's truth here."""
    matched = ext.join(pairs.select(run, F.col("ext_idx").alias("idx")), [run, "idx"], "left_semi").select(run, "norm_name", "parts").distinct().withColumn("twin", F.lit(True))
    kinds = false.join(matched, [run, "norm_name", "parts"], "left").withColumn("kind", F.when(F.col("twin"), "duplicate").otherwise("invention"))
    near = pair_similarity(false, base, run, least=0.0).withColumn("turn", F.row_number().over(W.partitionBy(run, "ext_idx").orderBy(F.desc("similarity"), F.desc("base_idx")))).where("turn = 1")
    return kinds.join(near.select(run, F.col("ext_idx").alias("idx"), F.col("base_idx").alias("nearest"), F.col("similarity").alias("nearest_similarity")), [run, "idx"], "left").drop("twin")
