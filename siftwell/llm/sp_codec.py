"""SentencePiece encoding and decoding by exact backtracking.

A SentencePiece model of merge type (BPE with byte fallback) is encoded without a merge loop over the text. At each
place the longest piece comes from an Aho-Corasick trie. It is kept if its string re-merges to that very piece and if
the string of the piece before it and it, merged anew, gives these two pieces again; otherwise the next shorter
piece is tried, and if none fits, the place is marked in a bitfield of failed places and the last piece is taken back.
A sequence all of whose neighbours are compatible is the one that merging gives: up to the first merge across a
border, both neighbours merge as they do on their own, so such a merge would also happen in the pair.

No piece of such a model holds a blank after another character, so a text falls into segments (blanks and what follows
them up to the next blank or line break) that are encoded on their own. Segments repeat, so each worker keeps a
bounded store of them.

Results for odd inputs: a null or empty text has no pieces (the end id alone); characters that no piece covers become
their UTF-8 byte pieces; U+2581 counts as a blank, as in the library.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from siftwell.plans.staging import ship_package

BLANK = "▁"
#: Entries of each of the two generations of a worker's stores; about 115 MB of all stores together.
STORE = 150_000
#: The same for segments, whose entries are two texts each.
SEGMENTS = 200_000
_SEGMENT = re.compile(r"[ ]*[^ \n]+|\n|[ ]+")


class Store(dict):
    """A dict that fills itself by `make` and keeps between `size` and twice `size` of the latest entries."""

    def __init__(self, make: Callable, size: int = STORE):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old[key] if key in self.old else self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def release(self) -> None:
        self.clear()
        self.old = {}


class MergeModel:
    """The pieces of a .model file of merge type, with encode() and decode()."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError("the model isn't of merge type with byte fallback and without normalisation")
        self.prefix = " " if norm.add_dummy_prefix else ""
        self.eos = self.library.eos_id()
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        for i, p in enumerate(proto.pieces):
            if p.type == 1:
                text = p.piece.replace(BLANK, " ")
                if re.search(r"[^ ] ", text):
                    raise ValueError(f"piece {i} holds a blank after another character")
                self.score[text], self.id[text] = p.score, i
            elif p.type == 6:
                self.byte_id[int(p.piece[1:-1], 16)] = i
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.text_of = {i: p for p, i in self.id.items()}
        self.written = list(map(str, range(len(proto.pieces))))
        self.widest = max(map(len, self.id))
        self._chosen: dict[str | None, dict[str, str | None]] = {}
        self._n_chosen = 0
        self._shorter = Store(lambda piece: self._cut(piece[:-1]))
        self._pairs = Store(self._compatible)
        self.segments = Store(self._segment, SEGMENTS)
        self._grow()
        trie = ahocorasick.Automaton()
        for p in self.id:
            trie.add_word(p, 0)
        self.longest = trie.longest_prefix

    def release(self) -> None:
        """Empty the stores: a worker outlives its task, and the next one's stage needs the memory."""
        for store in (self._shorter, self._pairs, self.segments):
            store.release()
        self._chosen, self._n_chosen = {}, 0

    def _grow(self) -> None:
        """How each piece comes about: its place in merge order and the two parts of its last merge.

        `odd` holds the pieces whose order isn't plain (a part merged no earlier than the whole, or a shared score).
        """
        shared = Counter(self.score.values())
        order = {p: k for k, p in enumerate(sorted(self.score, key=lambda p: -self.score[p]), 1)}
        self.formed, self.parts, self.odd, self.unsound = {}, {}, set(), set()
        for p in self.id:
            if len(p) == 1:
                self.formed[p] = 0
                continue
            parts, last = self._trace(p)
            if len(parts) > 1:
                self.unsound.add(p)  # merging never gives it
                continue
            self.parts[p], self.formed[p] = last, order[p]
            if shared[self.score[p]] > 1 or any(len(x) > 1 and order[x] >= order[p] for x in last):
                self.odd.add(p)
        self.odd |= {p for p, parts in self.parts.items() if not self.unsound.isdisjoint(parts)}
        self.order = order
        self.id = {p: i for p, i in self.id.items() if p not in self.unsound}

    def _trace(self, text: str) -> tuple[list[str], tuple[str, str]]:
        parts, score, last = list(text), self.score, ("", "")
        while len(parts) > 1:
            found = [(score[x], -i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in score]
            if not found:
                break
            i = -max(found)[1]
            last = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts, last

    def merge(self, text: str) -> list[str]:
        """Merging itself, as the model defines it: the best-scored neighbours first, leftmost if equal."""
        return self._trace(text)[0]

    def _compatible(self, pair: tuple[str, str]) -> bool:
        """Whether two pieces side by side stay as they are, re-merging only what meets at their border.

        Both are taken apart along the border, the part merged last first. Any two parts that ever met there must not
        make a piece that merging would have made before one of them grew on.
        """
        a, b = pair
        if a in self.odd or b in self.odd:
            return self.merge(a + b) == [a, b]
        order, formed, parts, odd = self.order, self.formed, self.parts, self.odd
        until = 1 << 60
        while True:
            made = order.get(a + b)
            if made is not None and made < until:
                return False
            fa, fb = formed[a], formed[b]
            if not fa and not fb:
                return True
            if fa > fb:
                until, a = fa, parts[a][1]
            else:
                until, b = fb + 1, parts[b][0]
            if a in odd or b in odd:
                return self.merge(pair[0] + pair[1]) == list(pair)

    def _cut(self, path: str) -> str | None:
        """The longest piece that a way into the trie starts with."""
        return next((path[:n] for n in range(len(path), 0, -1) if path[:n] in self.id), None)

    def _choose(self, before: str | None, path: str) -> str | None:
        """The longest piece at a place that goes with the piece before it; path: the way into the trie from there.

        What was chosen is kept by the piece before, up to twice STORE places in all.
        """
        token = self._cut(path)
        while token is not None and before is not None and not self._pairs[before, token]:
            token = self._shorter[token]
        if self._n_chosen >= 2 * STORE:
            self._chosen.clear()
            self._n_chosen = 0
        self._chosen.setdefault(before, {})[path] = token
        self._n_chosen += 1
        return token

    def pieces(self, text: str) -> list[str]:
        """Pieces of a segment, by backtracking; characters that no piece covers stand for themselves."""
        longest, chosen, known, wide = self.longest, self._chosen, self.id, self.widest
        out: list[str] = []
        n, pos, failed, before = len(text), 0, 0, None
        while pos < n:
            path = text[pos : pos + wide]
            path = path[: longest(path)]
            try:
                token = chosen[before][path]
            except KeyError:
                token = self._choose(before, path)
            if token is not None and not failed:  # a piece of the trie, so a known one
                out.append(token)
                pos += len(token)
                before = token
                continue
            while token is None or failed and failed >> (pos + len(token)) & 1:
                if token is None and text[pos] not in known:
                    token = text[pos]
                    break
                if token is None:  # nothing fits here: mark the place, take the last piece back
                    failed |= 1 << pos
                    token = out.pop()
                    pos -= len(token)
                    before = out[-1] if out and out[-1] in known else None
                token = self._shorter[token] if token in known else None
                while token is not None and before is not None and not self._pairs[before, token]:
                    token = self._shorter[token]
            out.append(token)
            pos += len(token)
            before = token if token in known else None
        return out

    def _ids(self, segment: str) -> list[int]:
        pieces = self.pieces(segment)
        try:
            return list(map(self.id.__getitem__, pieces))
        except KeyError:
            return [i for p in pieces for i in ([self.id[p]] if p in self.id else [self.byte_id[b] for b in p.encode()])]

    def decode(self, ids) -> str:
        """Text of ids: pieces joined, byte pieces read as UTF-8, without the blank that encoding put first."""
        raw = bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
            elif i != self.eos:
                raw += self.text_of.get(i, "").encode()
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def _segment(self, segment: str) -> str:
        """The ids of a segment in decimal; a zero byte and the text decoded from them follow where that isn't the segment."""
        ids = self._ids(segment)
        try:
            text = "".join(map(self.text_of.__getitem__, ids))
        except KeyError:  # byte pieces
            text = b"".join(bytes((self.byte_of[i],)) if i in self.byte_of else self.text_of[i].encode() for i in ids).decode("utf-8", "replace")
        written = " ".join(map(self.written.__getitem__, ids))
        return written if text == segment else f"{written}\0{text}"

    def split(self, text: str) -> list[str]:
        return _SEGMENT.findall(self.prefix + text.replace(BLANK, " ")) if text else []

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, without begin or end id."""
        return list(map(int, " ".join([self.segments[s].partition("\0")[0] for s in self.split(text or "")]).split()))

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids with the end id, the ids in decimal, and the text decoded from them."""
        parts = self.split(text or "")
        if not parts:
            return 1, str(self.eos), ""
        ids, decoded = " ".join(map(self.segments.__getitem__, parts)), "".join(parts)
        if "\0" in ids:
            found = [(s, *self.segments[s].partition("\0")) for s in parts]
            ids, decoded = " ".join([x[1] for x in found]), "".join([x[3] if x[2] else x[0] for x in found])
        if self.prefix and decoded.startswith(" "):
            decoded = decoded[1:]
        return ids.count(" ") + 2, f"{ids} {self.eos}", decoded


@lru_cache(maxsize=2)
def load(path: str) -> MergeModel:
    return MergeModel(path)


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """docs with the ids of `text` (end id last) in the column `ids`, and what they decode to in `decoded`.

    Columns of these names in docs are replaced. A null text encodes as an empty one.
    """
    ship_package(docs.sparkSession)
    schema = docs.drop(ids, "decoded").schema.add(ids, ArrayType(IntegerType())).add("decoded", "string")
    names = docs.drop(ids, "decoded").columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    got = [model.digest(t.as_py()) for t in part.column(text)]
                    flat = np.array(" ".join([x[1] for x in got]).split(), np.int32)
                    ends = np.cumsum([0] + [x[0] for x in got], dtype=np.int32)
                    new = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array([x[2] for x in got], pa.string())]
                    yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *new], names=[*names, ids, "decoded"])
        finally:
            model.release()

    return docs.select(*names).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens with the end id, and hashes of ids and of the decoded text.

    Rows that repeat are each answered; an empty table gives an empty one; columns beyond doc_id and text aren't read.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sha = load(path), hashlib.sha256
        try:
            for batch in batches:
                n, a, b = [], [], []
                for t in batch.column(1):
                    k, ids, decoded = model.digest(t.as_py())
                    n.append(k)
                    a.append(sha(ids.encode()).hexdigest())
                    b.append(sha(decoded.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            model.release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
