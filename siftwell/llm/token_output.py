"""Token ids as Arrow files with fixed-size-list batches.

Documents are dealt out by ranges of doc_id and sorted, so that each task writes one file: the ids of its documents one
after another, each with the end id, cut into sequences of equal length. A record batch holds a fixed number of
sequences (`ids`: fixed_size_list of unsigned integers, `mask`: fixed_size_list of booleans, false where the last
sequence is padded), so id k of a file lies at a place that needs no search, and a memory map reads it without a copy.
A file is written under a name of its own and then moved, so a task that runs again leaves one whole file.

Ids come from the `tokenizers` library's model, a pre-token at a time, with a bounded store of segments that repeat. A
segment ends where a non-blank is followed by a space; no pre-token of the byte-level pattern crosses that. Texts that
hold a special token's string are given to the library as a whole.

Null and empty texts have the end id alone. A null doc_id sorts first. Rows that repeat a doc_id are ordered by a hash of
their text; each is kept.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.llm.sp_codec import Store
from siftwell.plans.staging import new_folder, ship_package, stage

#: Ids of a sequence, and sequences of a record batch.
LENGTH, BATCH = 2048, 256
_EDGE = re.compile(r"(?<=\S)(?= )")
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")


class Encoder:
    """Ids of a byte-level BPE file as little-endian bytes."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: The byte-level pre-tokeniser's fixed pattern, and its characters for bytes: printable ones stand for
        #: themselves, the others for 256 and on.
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.chars = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.of_id = [np.array([i], self.kind).tobytes() for i in range(self.library.get_vocab_size())]
        self.tokenize = self.library.model.tokenize
        self.words = Store(self._word, 300_000)
        self.segments = Store(self._segment, 50_000)
        self.spaced = Store(lambda word: self._segment(" " + word), 700_000)

    def _word(self, word: str) -> bytes:
        text = word.encode().decode("latin-1").translate(self.chars)
        return b"".join([self.of_id[t.id] for t in self.tokenize(text)])

    def _segment(self, segment: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.split(segment)))

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        if "  " in text or " \n" in text or "\n " in text or _ODD.search(text):
            return b"".join(map(self.segments.__getitem__, _EDGE.split(text)))
        first, *rest = text.split(" ")
        return self._segment(first) + b"".join(map(self.spaced.__getitem__, rest))


@lru_cache(maxsize=2)
def load(path: str) -> Encoder:
    return Encoder(path)


def _places(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Writer:
    """Ids to sequences to record batches; holds one batch."""

    def __init__(self, uri: str, kind: np.dtype, length: int, batch: int):
        self.fs, self.path = _places(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        item = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.fs.open_output_stream(self.own)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.kind, self.length, self.limit = kind, length, batch * length * kind.itemsize
        self.held: list[bytes] = []
        self.size = 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.limit:
            data = b"".join(self.held)
            whole = len(data) // self.limit * self.limit
            for at in range(0, whole, self.limit):
                self.put(np.frombuffer(data, self.kind, self.limit // self.kind.itemsize, at), self.limit // self.kind.itemsize)
            self.held, self.size = [data[whole:]], len(data) - whole

    def put(self, ids: np.ndarray, n: int) -> None:
        mask = pa.array(np.arange(len(ids)) < n)
        self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(mask, self.length)], schema=self.schema))

    def close(self) -> None:
        ids = np.frombuffer(b"".join(self.held), self.kind)
        if len(ids):
            self.put(np.concatenate([ids, np.zeros(-len(ids) % self.length, self.kind)]), len(ids))
        self.out.close()
        self.sink.close()
        self.fs.move(self.own, self.path)


class Reader:
    """Ids of a file by place; a local file is mapped, not read."""

    def __init__(self, uri: str):
        from pyarrow import fs

        system, path = _places(uri)
        self.file = pa.ipc.open_file(pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path))
        self.length = self.file.schema.field("ids").type.list_size
        self.batches = [self.file.get_batch(k) for k in range(self.file.num_record_batches)]
        self.per = (self.batches[0].num_rows if self.batches else 1) * self.length

    def ids(self, start: int, n: int) -> np.ndarray:
        parts = []
        while n > 0:
            k, at = divmod(start, self.per)
            flat = self.batches[k].column("ids").values.to_numpy()[at : at + n]
            parts.append(flat)
            start, n = start + len(flat), n - len(flat)
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, "<u2")])

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of the k-th sequence."""
        batch, at = divmod(k, self.per // self.length)
        cut = slice(at * self.length, (at + 1) * self.length)
        flat = [self.batches[batch].column(c).values for c in ("ids", "mask")]
        return flat[0].to_numpy()[cut], flat[1][cut.start : cut.stop].to_numpy(zero_copy_only=False)


def write_files(docs: DataFrame, path: str, to: str, end_id: int = 0, length: int = LENGTH, batch: int = BATCH) -> DataFrame:
    """Write the files below the URI `to`; return their index: shard, file, doc_id, place in the file, n_tokens."""
    spark = docs.sparkSession
    ship_package(spark)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard = load(path), TaskContext.get().partitionId()
        uri, end, writer, place = f"{to}/{shard:06d}.arrow", np.array([end_id], encoder.kind).tobytes(), None, 0
        for part in batches:
            sizes, places = [], []
            for t in part.column(1):
                writer = writer or Writer(uri, encoder.kind, length, batch)
                ids = encoder(t.as_py() or "") + end
                writer.add(ids)
                k = len(ids) // encoder.kind.itemsize
                sizes.append(k)
                places.append(place)
                place += k
            rows = part.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([shard] * rows, pa.int32()), pa.array([uri] * rows), part.column(0), pa.array(places, pa.int64()), pa.array(sizes, pa.int64())], names=["shard", "file", "doc_id", "place", "n_tokens"])
        if writer:
            writer.close()

    return stage(dealt.mapInArrow(run, "shard int, file string, doc_id long, place long, n_tokens long"), "token-index")


def read_files(index: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start over all files, n_tokens, and the crc32 of its ids."""
    ship_package(index.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, name = None, None
        for part in batches:
            crc = []
            for file, place, n in zip(*(part.column(k).to_pylist() for k in (1, 3, 4))):
                if file != name:
                    reader, name = Reader(file), file
                crc.append(zlib.crc32(reader.ids(place, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), part.column(4), pa.array(crc, pa.int64())], names=["shard", "doc_id", "place", "n_tokens", "ids_crc32"])

    # One row a file: few, whatever the rows.
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
    before = totals.select("shard", F.coalesce(F.sum("ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    read = index.mapInArrow(run, "shard int, doc_id long, place long, n_tokens long, ids_crc32 long")
    return read.join(before, "shard").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def token_files(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    return read_files(write_files(docs, path, new_folder(spark, "tokens")))
