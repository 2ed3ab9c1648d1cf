"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j): single terms have weights, pairs of terms have the
product of their vectors, so that an insult together with a group's mention can count for more than both alone. Terms
are lower-cased words and the first letters of longer words; only the text is used. A term's value is its share of the text's words, raised so that one word in `SHARE` counts fully. Every word of a text counts.

Labels are learned from a sample of at most `max_rows` labelled documents (a parameter; the sample is the rows with the
lowest hash of doc_id). A term gets a weight and a vector if it tells something about the label: alone (its presence goes
with the label by `LEAST` standard deviations beyond chance), or together with another word: for each two words that `OFTEN`
of the sample hold, the shares of toxic documents with both, one or none of them are compared, and both words stay if the
interaction (both - first - second + none) is `PAIRED` standard deviations from 0. So words that say nothing alone are
learned where they matter together. Terms are counted by Spark; the sample's telling terms go to the driver. The model is
fitted with AdaGrad in a fixed order, so reruns agree.

Defined results: null and empty texts have no terms; they get the score of the bias alone. A null doc_id is in no fold:
held_out is false, and such labels aren't learned from. Rows that repeat a doc_id are each scored; repeated labels of a
document count once each. Labels that are null are left out; without any label every score is one half. An empty table
gives an empty one. Columns beyond doc_id and text are kept by score() as they are, but for one named as the score's.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.sp_codec import Store
from siftwell.plans.staging import drop, ship_package, stage

SLOTS, RANK, SHARE, MAX_ROWS = 1 << 20, 4, 40, 16_000
#: How many standard deviations from chance a term must be to be learned.
LEAST = 4.5
#: The share of the sample that must hold a word for it to be paired (so paired words are at most the mean number of
#: distinct words of a text over it), documents that each case of a pair needs, standard deviations of its interaction.
OFTEN, CASES, PAIRED = 0.04, 10, 8.0
#: Letters of a word's beginning that make terms of their own.
STARTS = (4, 5, 6, 7)
_WORD = re.compile(r"[^\W_]+")


def _slots(word: str) -> bytes:
    terms = [word] + [f"{word[:n]}-" for n in STARTS if len(word) >= n]
    return np.array([zlib.crc32(t.encode()) % SLOTS for t in terms], "<i4").tobytes()


def _found(store: Store, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of a text's terms, their values, and the slots of its whole words."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.int64)
    entries = [store[w] for w in words]
    slots, n = np.unique(np.frombuffer(b"".join(entries), "<i4"), return_counts=True)
    whole = np.unique(np.frombuffer(b"".join([e[:4] for e in entries]), "<i4"))
    return slots.astype(np.int64), np.minimum(1.0, n * (SHARE / len(words))).astype(np.float32), whole.astype(np.int64)


def _terms(store: Store, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a text's terms and their values."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    slots, n = np.unique(np.frombuffer(b"".join([store[w] for w in words]), "<i4"), return_counts=True)
    return slots.astype(np.int64), np.minimum(1.0, n * (SHARE / len(words))).astype(np.float32)


def paired(words: list[np.ndarray], toxic: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Of the slots `often` (sorted), those whose interaction with another one goes with the label; words: slots of each text."""
    n = len(often)
    both, bad = np.zeros((n, n), np.float32), np.zeros((n, n), np.float32)
    for k in range(0, len(words), 512):
        part = words[k : k + 512]
        x = np.zeros((len(part), n), np.float32)
        for i, w in enumerate(part):
            x[i, np.searchsorted(often, w)] = 1
        y = x[toxic[k : k + 512] > 0]
        both += x.T @ x
        bad += y.T @ y
    total, rows = float((toxic > 0).sum()), float(len(words))
    share = total / max(rows, 1)
    alone, alone_bad = np.diag(both).copy(), np.diag(bad).copy()
    hit = np.zeros(n, bool)
    for i in range(n):  # a row of the matrices at a time
        cases = [(both[i], bad[i]), (alone[i] - both[i], alone_bad[i] - bad[i]), (alone - both[i], alone_bad - bad[i])]
        cases.append((rows - alone[i] - cases[2][0], total - alone_bad[i] - cases[2][1]))
        enough = np.minimum.reduce([c for c, _ in cases]) >= CASES
        p, q, r, s = (t / np.maximum(c, 1) for c, t in cases)
        spread = share * (1 - share) * sum(1 / np.maximum(c, 1) for c, _ in cases)
        hit[i] = (enough & (np.abs(p - q - r + s) >= PAIRED * np.sqrt(np.maximum(spread, 1e-12)))).any()
    return often[hit]


class Machine:
    def __init__(self, seed: int = 7):
        self.seed, self.bias, self.used = seed, 0.0, np.zeros(0, np.int64)
        self.w = np.zeros(SLOTS, np.float32)
        self.v = np.zeros((SLOTS, RANK), np.float32)

    def packed(self) -> tuple:
        """Only what has weights."""
        return self.bias, self.used, self.w[self.used], self.v[self.used]

    @classmethod
    def unpacked(cls, packed: tuple) -> "Machine":
        m = cls()
        m.bias, m.used, m.w[packed[1]], m.v[packed[1]] = packed[0], packed[1], packed[2], packed[3]
        return m

    def margins(self, slots: np.ndarray, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the texts whose terms begin at `at` in slots."""
        n = len(at)
        own = np.repeat(np.arange(n), np.diff(np.append(at, len(slots))))
        v = self.v[slots] * x[:, None]
        single = np.bincount(own, self.w[slots] * x, n)
        both = np.stack([np.bincount(own, v[:, k], n) for k in range(RANK)], 1)
        square = np.bincount(own, (v * v).sum(1), n)
        return self.bias + single + 0.5 * ((both**2).sum(1) - square)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], batch: int = 64, rate: float = 0.2, shrink: float = 2e-5) -> None:
        """At least 8 rounds; more over few rows, up to 60, so that about 60,000 rows are seen."""
        rng = np.random.default_rng(11)
        if not rows:
            return
        y_all = np.array([r[2] for r in rows], np.float32)
        self.used = np.unique(np.concatenate([r[0] for r in rows]))
        self.v[self.used] = np.random.default_rng(self.seed).normal(0, 0.05, (len(self.used), RANK))
        rare = max(1.0, min(20.0, (1 - y_all.mean()) / max(y_all.mean(), 1e-3))) ** 0.5
        gw, gv, gb = np.full(SLOTS, 1e-6, np.float32), np.full(SLOTS, 1e-6, np.float32), 1e-6
        for _ in range(max(8, min(60, 60_000 // len(rows)))):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), batch):
                part = [rows[i] for i in order[k : k + batch]]
                slots = np.concatenate([r[0] for r in part])
                x = np.concatenate([r[1] for r in part])
                sizes = np.array([len(r[0]) for r in part])
                at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                y = y_all[order[k : k + batch]]
                own = np.repeat(np.arange(len(part)), sizes)
                p = 1 / (1 + np.exp(-np.clip(self.margins(slots, x, at), -30, 30)))
                g = (p - y) * np.where(y > 0, rare, 1) / len(part)
                v = self.v[slots] * x[:, None]
                both = np.stack([np.bincount(own, v[:, j], len(part)) for j in range(RANK)], 1)
                uniq, back = np.unique(slots, return_inverse=True)
                dw = np.bincount(back, g[own] * x, len(uniq)) + shrink * self.w[uniq]
                gw[uniq] += dw**2
                self.w[uniq] -= (rate * dw / np.sqrt(gw[uniq])).astype(np.float32)
                each = (g[own] * x)[:, None] * (both[own] - v)
                dv = np.stack([np.bincount(back, each[:, j], len(uniq)) for j in range(RANK)], 1) + shrink * self.v[uniq]
                gv[uniq] += (dv**2).mean(1)
                self.v[uniq] -= (0.25 * rate * dv / np.sqrt(gv[uniq])[:, None]).astype(np.float32)
                gb += g.sum() ** 2
                self.bias -= float(rate * g.sum() / np.sqrt(gb))


def held_out(doc_id):
    """crc32 of the id as text, modulo 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Machine:
    """Fit on labelled rows outside the held-out fold; labels that are null are left out."""
    ship_package(docs.sparkSession)
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")  # at most max_rows small rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(_slots, 60_000)
        packed = lambda arrays, kind: pa.array([a.astype(kind).tobytes() for a in arrays], pa.binary())
        for b in batches:
            got = [_found(store, t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed([g[0] for g in got], "<i4"), packed([g[1] for g in got], "<f4"), packed([g[2] for g in got], "<i4")], names=["doc_id", "toxic", "slots", "x", "words"])

    terms = stage(sample.mapInArrow(run, "doc_id long, toxic int, slots binary, x binary, words binary"), "tox-terms")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, bad, whole = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        for b in batches:
            for y, s, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                slots = np.frombuffer(s, "<i4")  # distinct in a text
                n[slots] += 1
                bad[slots] += y
                whole[np.frombuffer(w, "<i4")] += 1
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(bad[some]), pa.array(whole[some])], names=["slot", "n", "bad", "whole"])

    total = terms.agg(F.count("*").alias("rows"), F.coalesce(F.avg((F.col("toxic") > 0).cast("double")), F.lit(0.0)).alias("share")).first()
    counts = terms.select((F.col("toxic") > 0).cast("int").alias("toxic"), "slots", "words").mapInArrow(count, "slot int, n long, bad long, whole long").groupBy("slot").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "whole")])
    # A term tells if its presence goes with the label more than chance lets expect; at most SLOTS numbers.
    expected = F.col("n") * total["share"]
    spread = expected * (1 - total["share"]) * (total["rows"] - F.col("n")) / max(1, total["rows"] - 1)
    alone = F.abs(F.col("bad") - expected) >= LEAST * F.sqrt(spread + 0.25)
    often = F.col("whole") >= max(CASES, OFTEN * total["rows"])
    known = counts.select("slot", alone.alias("alone"), often.alias("often")).where("alone OR often").toArrow()
    slots = known.column("slot").to_numpy()
    telling, frequent = slots[known.column("alone").to_numpy()], np.sort(slots[known.column("often").to_numpy()])

    def cut(keep_slots: np.ndarray, column: str):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keep = np.zeros(SLOTS, bool)
            keep[keep_slots] = True
            for b in batches:
                slots, x = [], []
                for s, v in zip(b.column(column).to_pylist(), b.column("x").to_pylist()):
                    s = np.frombuffer(s, "<i4")
                    slots.append(s[keep[s]].tobytes())
                    x.append(np.frombuffer(v, "<f4")[keep[s]].tobytes() if column == "slots" else b"")
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(slots, pa.binary()), pa.array(x, pa.binary())], names=["doc_id", "toxic", "slots", "x"])

        return terms.mapInArrow(of, "doc_id long, toxic int, slots binary, x binary").toArrow().sort_by("doc_id")

    if len(frequent):
        rows = cut(frequent, "words")
        telling = np.union1d(telling, paired([np.frombuffer(w.as_buffer(), "<i4") for w in rows.column("slots")], rows.column("toxic").to_numpy(), frequent))
    rows = cut(telling, "slots")
    drop(terms)
    machine = Machine()
    machine.fit([(np.frombuffer(s, "<i4").astype(np.int64), np.frombuffer(x, "<f4"), int(y > 0)) for s, x, y in zip(*(rows.column(k).to_pylist() for k in ("slots", "x", "toxic")))])
    return machine


def score(docs: DataFrame, machine: Machine, text: str = "text", into: str = "toxicity") -> DataFrame:
    """docs with a column of scores from 0 to 1; one of that name is replaced."""
    spark = docs.sparkSession
    ship_package(spark)
    model = spark.sparkContext.broadcast(machine.packed())  # at most SLOTS * (RANK + 2) numbers, whatever the rows
    names = [c for c in docs.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine.unpacked(model.value)
        store = Store(_slots, 60_000)
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                got = [_terms(store, t.as_py()) for t in b.column(text)]
                sizes = np.array([len(s) for s, _ in got])
                z = m.margins(np.concatenate([s for s, _ in got]), np.concatenate([x for _, x in got]), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(p, pa.float64())], names=[*names, into])

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, docs.select(*[F.col(f"`{c}`") for c in names]).schema.add(into, "double"))


def predictions(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per document: doc_id, whether it is held out, its score, and 1 where that is 0.5 or more."""
    machine = train(docs, labels, max_rows)
    return score(docs.select("doc_id", "text"), machine, into="score").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
