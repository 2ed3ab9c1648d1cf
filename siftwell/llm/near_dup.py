"""Near-duplicate documents: MinHash signatures joined within a Hamming distance by a multi-index.

A document's set is its distinct shingles of five words. Documents with one set are one class, and classes are what is
joined. A signature has `SLOTS` slots of b = 16 bits. Slots fall into `CHUNKS` chunks; if two signatures differ in at most
`DISTANCE` slots, some chunk differs in at most DISTANCE // CHUNKS = 1 slot, so a key for each chunk and each slot left out
of it brings all such pairs together. (At a similarity of 0.75 a slot differs with probability 1/4; more than 31 of 64
differ once in about 10^5 pairs.)

Groups are not expanded into pairs. First each member of a bucket is compared with the bucket's smallest member (a star),
and what links is joined into components. After that only members of a bucket that are still in different components
are compared: those of its largest component, each once, with the outsiders, and the outsiders with each other, signature
with signature in blocks of about `BLOCK` rows, a pair only in the first bucket that both are in. What passes the distance
then has to pass one of two tests. Sets of up to `WHOLE` shingles carry all their hashes, cut to 16 bits, so a pair of which
one has at most `WHOLE` * LINK / 100 shingles has to reach a bound that no link falls short of. Longer sets carry a second
sketch (`BINS` minima of one permutation; a pair at the threshold falls short of it with odds of about 1 in 10^5). Whatever
goes on is confirmed on full sets.

Defined results: without words the set is empty and the document links with nothing; with one to four words the whole
sequence is its one shingle. A null doc_id takes no part: its component is null and it is kept. Rows that repeat a doc_id
are one node. Sets are compared as 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.sp_codec import Store
from siftwell.plans.staging import drop, ship_package, stage

WIDTH, SLOTS, CHUNKS, DISTANCE, BINS, BLOCK = 5, 64, 16, 31, 512, 1024
#: A link: 100 * intersection >= LINK * union. The second sketch may be short of it by this many standard deviations.
LINK, ALLOWANCE = 75, 4.3
#: Sets of up to this many shingles go to the comparison with all their hashes (2 bytes each); as many as the sketch has bins.
WHOLE = BINS
#: Ids up to this many are broadcast (8 bytes each); more are joined by a shuffle.
FEW = 2_000_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(75)
    return rng.integers(0, 1 << 32, SLOTS, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, SLOTS, dtype=np.uint32)


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts."""

    def __init__(self):
        import xxhash

        self.words = Store(xxhash.xxh3_64_intdigest, 100_000)
        self.turns = [_mix(np.array([k + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0] | np.uint64(1) for k in range(WIDTH)]

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        if len(h) < WIDTH:
            total = np.array([len(h)], np.uint64)
            for k in range(len(h)):
                total = _mix(total + h[k : k + 1] * self.turns[k])
            return total if len(h) else np.zeros(0, np.uint64)
        n = len(h) - WIDTH + 1
        total = h[:n] * self.turns[0]
        for k in range(1, WIDTH):
            total = total + h[k : k + n] * self.turns[k]
        return np.unique(_mix(total))


def _sketch(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (rows of SLOTS 16-bit slots) and second sketches (rows of BINS bytes, 0: nothing in the bin)."""
    sizes = np.array([len(s) for s in sets])
    sig, bins = np.zeros((len(sets), SLOTS), np.uint16), np.zeros((len(sets), BINS), np.uint8)
    full = np.flatnonzero(sizes)
    if not len(full):
        return sig, bins
    flat = np.concatenate([sets[k] for k in full])
    at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    low = (flat & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    a, b = _factors()
    for k in range(SLOTS):
        v = low * a[k]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x85EBCA6B)
        v += b[k]
        least = np.minimum.reduceat(v, at)
        least ^= least >> np.uint32(16)
        sig[full, k] = (least * np.uint32(0xC2B2AE35) >> np.uint32(16)).astype(np.uint16)
    # Sets are sorted, so a set's first hash in a bin of the highest bits is the bin's least.
    own = np.repeat(full, sizes[full])
    place = own * BINS + (flat >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.concatenate([[True], place[1:] != place[:-1]])
    bins.reshape(-1)[place[first]] = (low[first] % np.uint32(255) + 1).astype(np.uint8)
    return sig, bins


def _cut(hashes: np.ndarray) -> np.ndarray:
    """Distinct 16-bit values of a set's hashes, none of them 0."""
    return np.unique(np.maximum((hashes & np.uint64(0xFFFF)).astype(np.uint16), np.uint16(1)))


def may_link(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which pairs of sets may link; a pair that links is never left out.

    x, y: rows of the sets' values by `_cut`, filled up with 0; n, m: the sets' sizes. What two sets have in common gives at least
    as many common values but for those that fell together within the first.
    """
    used = [(z > 0).sum(1) for z in (x, y)]
    both = np.sort(np.concatenate([z[:, : u.max(initial=0)] for z, u in zip((x, y), used)], 1), 1)
    common = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] > 0)).sum(1) + n - used[0]
    return 100 * common >= LINK * (n + m - common)


def _rows(column: pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    """A binary column as rows of values, filled up with 0."""
    values = column.to_pylist()
    sizes = np.array([len(v) for v in values]) // np.dtype(kind).itemsize
    out = np.zeros((len(values), width), kind)
    out[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(values), kind)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, two hashes of the set, signature, second sketch (of sets that some longer one than `WHOLE`
    could link with), and the set's hashes in 16 bits (of sets up to `WHOLE`). What a row doesn't have is empty."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        weights = _mix(np.array([3, 5], np.uint64))
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                part = whole.slice(k, 256)
                sets = [shingles(t.as_py()) for t in part.column(1)]
                sig, bins = _sketch(sets)
                sums = [[int(_mix(s + w).sum().view(np.int64)) if len(s) else 0 for s in sets] for w in weights]
                binary = [
                    [r.tobytes() if len(s) else b"" for r, s in zip(sig, sets)],
                    [r.tobytes() if 100 * len(s) > LINK * WHOLE else b"" for r, s in zip(bins, sets)],
                    [_cut(s).tobytes() if len(s) <= WHOLE else b"" for s in sets],
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x, pa.int64()) for x in sums), *(pa.array(x, pa.binary()) for x in binary)],
                    names=["doc_id", "n_shingles", "h1", "h2", "sig", "bins", "whole"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, sig binary, bins binary, whole binary")


def _key(sig: np.ndarray, out: int | np.ndarray, chunk: int | np.ndarray) -> np.ndarray:
    """Keys of chunks (rows of slots) with the slot `out` left out."""
    wide = SLOTS // CHUNKS
    packed = np.zeros(sig.shape[:-1], np.uint64)
    for k in range(wide):
        packed = np.where(np.asarray(out) == k, packed, (packed << np.uint64(16)) | sig[..., k].astype(np.uint64))
    place = (np.asarray(chunk) * wide + np.asarray(out)).astype(np.uint64)
    return _mix(packed * np.uint64(SLOTS) + place).view(np.int64)


def _keys(classes: DataFrame) -> DataFrame:
    """key, cls: for each class and chunk a key for each slot left out."""
    wide = SLOTS // CHUNKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, CHUNKS, wide)
            keys = np.stack([_key(sig, out, np.arange(CHUNKS)) for out in range(wide)], 2)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(part.column(0).to_numpy(), SLOTS))], names=["key", "cls"])

    return classes.select("cls", "sig").mapInArrow(run, "key long, cls long")


def _first_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first key that the signatures of each row pair share; pairs are within the distance, so there is one."""
    wide = SLOTS // CHUNKS
    differ = (x != y).reshape(-1, CHUNKS, wide)
    chunk = (differ.sum(2) <= 1).argmax(1)
    row = np.arange(len(x))
    return _key(x.reshape(-1, CHUNKS, wide)[row, chunk], differ[row, chunk].argmax(1), chunk)


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keep = []
            for x, y in zip(part.column(2), part.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(p), len(q)) < LINK * max(len(p), len(q)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= LINK * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a")
    return left.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _compare(members: DataFrame) -> DataFrame:
    """Pairs of one bucket and block pair that are in different components and may link.

    members: key, p, q (blocks), own (the row's block), cls, comp, n_shingles, sig, bins, whole; sorted by (key, p, q) within partitions. A row
    is compared with those that follow it at distance 1, 2, ... in its group, all groups at once.
    """
    share = LINK / 100

    def fits(cols: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return may_link(cols["whole"][x], cols["whole"][y], cols["n_shingles"][x], cols["n_shingles"][y])

    def near_bins(cols: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        u, v = cols["bins"][x], cols["bins"][y]
        same, some = ((u == v) & (u > 0)).sum(1), ((u | v) > 0).sum(1)
        return same >= share * some - ALLOWANCE * np.sqrt(share * (1 - share) * some)

    def compared(cols: dict[str, np.ndarray], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out_a, out_b = [], []
        row = np.arange(len(group))
        step = 1
        while len(row := row[row + step < len(group)]):
            row = row[group[row] == group[row + step]]
            if not len(row):
                break
            then = row + step
            fit = cols["comp"][row] != cols["comp"][then]
            fit &= (cols["p"][row] == cols["q"][row]) | (cols["own"][row] != cols["own"][then])
            i, j = row[fit], then[fit]
            for k in range(0, len(i), 4096):
                x, y = i[k : k + 4096], j[k : k + 4096]
                near = (cols["sig"][x] != cols["sig"][y]).sum(1) <= DISTANCE
                x, y = x[near], y[near]
                here = _first_shared(cols["sig"][x], cols["sig"][y]) == cols["key"][x]
                x, y = x[here], y[here]
                n, m = cols["n_shingles"][x], cols["n_shingles"][y]
                alike = 100 * np.minimum(n, m) >= LINK * np.maximum(n, m)
                short = 100 * np.minimum(n, m) <= LINK * WHOLE
                for x, y, which in ((x[alike & short], y[alike & short], fits), (x[alike & ~short], y[alike & ~short], near_bins)):
                    may = which(cols, x, y)
                    out_a.append(cols["cls"][x[may]])
                    out_b.append(cols["cls"][y[may]])
            step += 1
        a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (out_a, out_b))
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(rows: list[pa.RecordBatch], last: bool):
            table = pa.Table.from_batches(rows).combine_chunks()
            n = table.num_rows
            named = {c: table.column(c).to_numpy() for c in ("key", "p", "q", "own", "cls", "comp", "n_shingles")}
            new = np.concatenate([[True], (named["key"][1:] != named["key"][:-1]) | (named["p"][1:] != named["p"][:-1]) | (named["q"][1:] != named["q"][:-1])])
            whole = n if last else int(np.flatnonzero(new)[-1])
            if whole:
                named = {c: v[:whole] for c, v in named.items()}
                part = table.slice(0, whole)
                for name, kind, width in (("sig", np.uint16, SLOTS), ("bins", np.uint8, BINS), ("whole", np.uint16, WHOLE)):
                    named[name] = _rows(part.column(name), kind, width)
                a, b = compared(named, np.cumsum(new[:whole]))
                pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["a", "b"])
            held[:] = table.slice(whole).to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= 4 * BLOCK:
                yield from work(held, False)
        if held:
            yield from work(held, True)

    return members.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, comp: the least node of each component; links: a, b. Nodes without links aren't in it.

    Every node takes the least label of itself and its neighbours, then labels are followed one step (a node's label's
    label), until nothing changes; each round is written, so a lost executor costs a round at most.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stage(both, "dup-edges")
    labels = stage(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "dup-labels")
    while True:
        seen = edges.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        near = labels.join(seen, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        new = stage(near.join(jump, "comp", "left").select("node", "was", F.least(F.col("comp"), F.coalesce("next", "comp")).alias("comp")), "dup-labels")
        drop(labels)
        labels = new
        if not new.where("was <> comp").limit(1).count():
            drop(edges)
            return labels.select("node", "comp")


def links(docs: DataFrame, sketched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes (cls, h1, h2, n_shingles) and the labels of those that link with another."""
    some = sketched.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    least = stage(some.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("cls")), "dup-classes")
    classes = stage(some.join(least, ["h1", "h2", "n_shingles"]).where("doc_id = cls").dropDuplicates(["cls"]).select("cls", "n_shingles", "sig", "bins", "whole"), "dup-sketches")
    keys = stage(_shared(_keys(classes)), "dup-keys")
    # Sets of the classes that share a bucket with another.
    ids = stage(keys.select("cls").distinct(), "dup-ids")
    want = F.broadcast(ids) if ids.count() <= FEW else ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for part in batches:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t.as_py()).tobytes() for t in part.column(1)], pa.binary())], names=["cls", "shingles"])

    texts = docs.select(F.col("doc_id").alias("cls"), "text").join(want, "cls", "left_semi")
    sets = stage(texts.mapInArrow(run, "cls long, shingles binary"), "dup-sets")
    star = keys.where("cls <> first").select(F.col("first").alias("a"), F.col("cls").alias("b")).distinct()
    first = stage(_verify(star, sets), "dup-star")
    comps = components(first)
    # What is left: members of a bucket in different components.
    member = keys.select("key", "cls").join(comps.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", F.coalesce("comp", "cls").alias("comp"))
    sizes = member.groupBy("key", "comp").agg(F.count("*").alias("n"))
    spread = sizes.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("total"), F.count("*").alias("comps")).where("comps > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    spread = spread.select("key", F.col("top.comp").alias("main"), blocks(F.col("top.n")).alias("main_blocks"), blocks(F.col("total") - F.col("top.n")).alias("out_blocks"))
    open_ = member.join(spread, "key").join(classes, "cls")
    own = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    cell = lambda p, q, o: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"), o.cast("int").alias("own"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # Negative cells hold a block of the largest component (own -1) and a block of outsiders; the others two blocks of outsiders.
    of_main = F.transform(every("out_blocks"), lambda j: cell(-1 - own("main_blocks"), j, F.lit(-1)))
    of_out = F.concat(
        F.transform(every("main_blocks"), lambda m: cell(-1 - m, own("out_blocks"), own("out_blocks"))), F.transform(every("out_blocks"), lambda j: cell(F.least(own("out_blocks"), j), F.greatest(own("out_blocks"), j), own("out_blocks")))
    )
    placed = open_.withColumn("cell", F.explode(F.when(F.col("comp") == F.col("main"), of_main).otherwise(of_out)))
    placed = placed.select("key", "cell.p", "cell.q", "cell.own", "cls", "comp", "n_shingles", "sig", "bins", "whole")
    ready = placed.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    rest = stage(_verify(_compare(ready).distinct(), sets), "dup-rest")
    return least, components(first.unionByName(rest))


def _shared(keys: DataFrame) -> DataFrame:
    """key, cls, first (the least class) of the buckets that hold two classes or more."""
    groups = keys.groupBy("key").agg(F.min("cls").alias("first"), F.max("cls").alias("last")).where("first <> last").select("key", "first")
    return keys.join(groups, "key")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least doc_id that it links with over any way), kept."""
    ship_package(docs.sparkSession)
    sketched = stage(signatures(docs), "dup-signatures")
    least, comps = links(docs, sketched)
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "cls", "doc_id"))
    rows = sketched.select("doc_id", "n_shingles", "h1", "h2").join(least, ["h1", "h2", "n_shingles"], "left")
    rows = rows.withColumn("cls", F.when(F.col("doc_id").isNotNull(), F.col("cls")))
    return rows.join(comps.withColumnRenamed("node", "cls"), "cls", "left").select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component: the one with its id; all rows with a null id. Equal rows stay equal rows."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(kept.kept_id), "left_semi")
