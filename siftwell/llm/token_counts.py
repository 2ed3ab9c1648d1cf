"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text above `chunk` characters is encoded in chunks that overlap, with the place of each token. Two neighbouring
chunks are spliced at a place that is proven to be a token border of the whole text; if the overlap shows none, it is
doubled, at last up to the whole chunk, and then both chunks are encoded as one.

Proof for merge-type SentencePiece models: a token that both chunks have at the same place is a splice point. Every
two neighbours of the spliced sequence are neighbours in one of the chunks, so merging their string anew keeps them
apart, and a sequence with that property is the one that merging gives. For `tokenizers` files the proof is the
pre-tokeniser's: it goes from left to right, so if both chunks begin a word at the same place (before the last words
of the left chunk, which may look ahead to its end), they agree from there on.

Null and empty texts have no tokens; n_bytes is 0. Special strings inside a text count as the library's default has it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from siftwell.plans.staging import ship_package

#: Characters of a chunk and of the first overlap; texts up to a chunk are encoded at once.
CHUNK, OVERLAP = 32_768, 256


class PieceEncoder:
    """A SentencePiece model; places are in bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def width(self, text: str) -> int:
        return len(text.encode())

    def placed(self, text: str) -> list[tuple[int, int, int]]:
        """(begin, end, id) of each token."""
        return [(p.begin, p.end, p.id) for p in self.model.encode(text, return_type="proto").pieces]

    def splice(self, left: list[tuple], right: list[tuple]) -> tuple[int, int, tuple] | None:
        """Tokens to keep of left, to drop of right, and the anchor: the last token that both have, with a width."""
        seen = {t: j for j, t in enumerate(right) if t[1] > t[0] and not self.model.is_byte(t[2])}
        return next(((i + 1, seen[left[i]] + 1, left[i]) for i in range(len(left) - 1, -1, -1) if left[i] in seen), None)

    def after(self, tokens: list[tuple], anchor: tuple) -> tuple[int, int] | None:
        """(0, tokens to drop so that those after the anchor stay), if it is there."""
        return next(((0, j + 1) for j, t in enumerate(tokens) if t == anchor), None)


class FileEncoder:
    """A `tokenizers` file; places are in characters."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def width(self, text: str) -> int:
        return len(text)

    def placed(self, text: str) -> list[tuple[int, int, int, bool]]:
        """(begin, end, id, whether it begins a word) of each token."""
        x = self.model.encode(text, add_special_tokens=False)
        words = [None, *x.word_ids]
        return [(*o, i, w != words[k]) for k, (o, i, w) in enumerate(zip(x.offsets, x.ids, x.word_ids))]

    def splice(self, left: list[tuple], right: list[tuple]) -> tuple[int, int, int] | None:
        begins = [i for i, t in enumerate(left) if t[3]][:-3]
        seen = {t[0]: j for j, t in enumerate(right) if t[3] and j}
        return next(((i, seen[left[i][0]], left[i][0]) for i in reversed(begins) if left[i][0] in seen), None)

    def after(self, tokens: list[tuple], anchor: int) -> tuple[int, int] | None:
        return next(((0, j) for j, t in enumerate(tokens) if t[3] and t[0] == anchor), None)


@lru_cache(maxsize=2)
def load(path: str) -> PieceEncoder | FileEncoder:
    return FileEncoder(path) if path.endswith(".json") else PieceEncoder(path)


def spliced(encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[int]]:
    """Ids of a text, in runs that joined are those of the whole text; holds two chunks at most, if they align."""

    def placed(low: int, high: int) -> list[tuple]:
        base = encoder.width(text[:low])
        return [(b + base, e + base, *x) for b, e, *x in encoder.placed(text[low:high])]

    start, end, anchor = 0, min(chunk, len(text)), None
    left = placed(0, end)
    while end < len(text):
        wide, then, cut = overlap, min(end + chunk, len(text)), None
        while not cut and end - wide > start:
            right = placed(end - wide, then)
            if cut := encoder.splice(left, right):
                yield [t[2] for t in left[: cut[0]]]
                left, start, anchor = right[cut[1] :], end - wide, cut[2]
            wide *= 2
        low = start
        while not cut:  # no common border: both chunks as one, from where the run before ended
            right = placed(low, then)
            cut = (0, 0) if anchor is None else encoder.after(right, anchor)
            if cut:
                left = right[cut[1] :]
            if not cut and not low:
                raise ValueError("a border of the whole text is missing in it")
            low = max(0, low - wide)
            wide *= 2
        end = then
    yield [t[2] for t in left]


def count(encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    return sum(map(len, spliced(encoder, text, chunk, overlap)))


def token_counts(docs: DataFrame, path: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row of docs: doc_id, n_bytes of the UTF-8 text, n_tokens, and whether these are above `limit`."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [0] * len(texts)
            short = [k for k, t in enumerate(texts) if len(t) <= chunk]
            for at in range(0, len(short), 64):
                part = short[at : at + 64]
                for k, ids in zip(part, encoder.ids([texts[k] for k in part])):
                    n[k] = len(ids)
            for k, t in enumerate(texts):
                if len(t) > chunk:
                    n[k] = count(encoder, t, chunk, overlap)
            sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
