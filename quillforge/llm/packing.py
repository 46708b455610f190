"""Pack tokenised documents into training windows by multiway differencing.

Each task tokenises its own rows and packs them in blocks of ``BLOCK_WINDOWS`` windows, so no
row is shuffled, and a hot source or a very long document only means more blocks.
"""

from __future__ import annotations

import heapq
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Windows that one differencing run fills.
BLOCK_WINDOWS = 160
#: Remainders are cut to at most this many tokens before differencing.
MAX_PIECE = 512
#: Tokens a window that a block aims to leave free, so that near-equal windows fit.
SLACK = 12
#: Words whose ids a worker keeps.
CACHE_WORDS = 200_000

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()),
])


#: A run of Latin letters, then one of punctuation: normalising such a word is lower-casing it, and
#: either run is a unit of the tokenizer's model.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?|]*)").fullmatch


#: Texts whose ids must be those of their words; other tokenizers are refused.
_PROBES = ("a b", " It's A,b..  c\nd\te1 \u00c9x", "don't|stop!", "x\u0301 \u65e5\u672c 12")


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level tokenizers write each byte: itself where printable, else from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b if b in shown else next(hidden)) for b in range(256)}


class WordIds:
    """Token ids of texts as little-endian uint32 bytes, word by word with bounded caches.

    The tokenizer drops white space and no pair of its merges spans it, so a text's ids are its
    words' ids in order. Words are cut at space, tab, line feed and carriage return only: other
    white space stays inside a word, for the tokenizer to handle. Plain words skip the normaliser
    and go to the tokenizer's model as they are.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.most, self.known, self.units = Tokenizer.from_file(path), most, {}, {}
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        for probe in _PROBES:
            if self(probe) != array("I", self.tokenizer.encode(probe, add_special_tokens=False).ids).tobytes():
                raise ValueError("the tokenizer's ids aren't those of its words; only one that drops white space is known here")

    def __call__(self, text: str) -> bytes:
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        known = self.known
        if missing := set(words).difference(known):
            if len(known) + len(missing) > self.most:
                known.clear()
                missing = set(words)
            self._learn(missing)
        return b"".join(map(known.__getitem__, words))

    def _unit(self, unit: str) -> bytes:
        got = self.units.get(unit)
        if got is None:
            if len(self.units) >= self.most:
                self.units.clear()
            tokens = self.model.tokenize(unit.encode().decode("latin-1").translate(self.letters))
            got = self.units[unit] = array("I", [t.id for t in tokens]).tobytes()
        return got

    def _learn(self, words: Iterable[str]) -> None:
        other = []
        for word in words:
            if m := _PLAIN(word):
                self.known[word] = self._unit(m[1].lower()) + (self._unit(m[2]) if m[2] else b"")
            else:
                other.append(word)
        for i in range(0, len(other), 1024):
            some = other[i : i + 1024]
            for word, got in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False), strict=True):
                self.known[word] = array("I", got.ids).tobytes()


_CODERS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's coder for a tokenizer; its cache serves all tasks of the worker."""
    if sys.byteorder != "little":
        raise RuntimeError("ids are written as the machine has them, which must be little-endian")
    if path not in _CODERS:
        _CODERS.clear()
        _CODERS[path] = WordIds(path)
    return _CODERS[path]


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Item numbers of ``k`` near-equal parts, by Karmarkar-Karp multiway differencing.

    A partial partition is a list of (sum, items), largest first, without its empty parts. The two
    partitions with the largest difference between their largest and smallest part are merged,
    largest part on smallest part, until one is left.
    """
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over <= 0:
            merged = a + b
        else:  # the smallest parts of a take the largest of b, the other way round for the rest
            if len(a) < len(b):
                a, b = b, a
            b_tail = b[::-1]
            alone = len(a) - over  # parts of a that meet an empty part of b
            merged = a[:alone]
            for (s, x), (t, y) in zip(a[alone:], b_tail[:over], strict=True):
                merged.append((s + t, x + y))
            merged += b_tail[over:]
        merged.sort(key=lambda p: -p[0])
        gap = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-gap, serial, merged))
        serial += 1
    parts = [items for _, items in heap[0][2]] if heap else []
    return parts + [[] for _ in range(k - len(parts))]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Differencing into the fewest windows; the count rises while one exceeds the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, k)
        if max((sum(sizes[i] for i in p) for p in parts), default=0) <= capacity:
            return [p for p in parts if p]
        k += 1


class Packer:
    """Cuts documents into pieces and places them; ``emit`` gets (sequence, pieces) in order."""

    def __init__(self, capacity: int, block: int = BLOCK_WINDOWS, max_piece: int = MAX_PIECE, slack: int = SLACK):
        self.capacity, self.max_piece = capacity, min(max_piece, capacity)
        self.goal = block * max(1, capacity - slack)
        self.held: list[tuple] = []
        self.total = 0

    def add(self, doc: object, ids: bytes) -> Iterator[list[tuple]]:
        """Pieces are (doc, start, length, crc32, doc_tokens, bytes)."""
        n, at = len(ids) // 4, 0

        def piece(size: int) -> tuple:
            part = ids[4 * at : 4 * (at + size)]
            return doc, at, size, zlib.crc32(part), n, part

        while n - at >= self.capacity:
            yield [piece(self.capacity)]
            at += self.capacity
        while at < n:
            size = min(self.max_piece, n - at, self.goal - self.total)
            self.held.append(piece(size))
            self.total += size
            at += size
            if self.total >= self.goal:
                yield from self.flush()

    def flush(self) -> Iterator[list[tuple]]:
        if self.held:
            for part in windows([p[2] for p in self.held], self.capacity):
                yield [self.held[i] for i in sorted(part)]
        self.held, self.total = [], 0


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, with_ids: bool = False
) -> DataFrame:
    """One row per piece of a document's tokens: where it lies in which sequence.

    Every row of ``docs`` (doc_id, text) is a document of its own, also where doc_ids repeat or are
    null. A null or empty text holds ``end_id`` alone. A document of any length is cut; each id
    lies in one piece. An empty table gives no rows; other columns are ignored. ``with_ids`` adds
    the ids as a binary column (little-endian uint32). Sequence ids are the task's partition and a
    running number: a task that runs again gives the same rows where it reads them in the same order, as from
    files. Behind a shuffle, write ``docs`` first.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = word_ids(tokenizer_path), Packer(capacity)
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        out: list[list] = [[] for _ in range(8)]

        def place(groups: Iterator[list[tuple]]) -> None:
            nonlocal sequence
            for group in groups:
                offset = 0
                for doc, start, size, crc, n, part in group:
                    for column, value in zip(out, (doc, start, size, crc, n, sequence, offset, part if with_ids else None), strict=True):
                        column.append(value)
                    offset += size
                sequence += 1

        def batch() -> pa.RecordBatch:
            made = [pa.array(c, pa.int64()) for c in out[:7]] + ([pa.array(out[7], pa.binary())] if with_ids else [])
            for c in out:
                c.clear()
            return pa.RecordBatch.from_arrays(made, names=[*SCHEMA.names, *["ids"] * with_ids])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                place(packer.add(doc, encode(text.as_py() or "") + end))
                if len(out[0]) >= 20_000:
                    yield batch()
        place(packer.flush())
        yield batch()

    schema = T.StructType([*SCHEMA.fields, *[T.StructField("ids", T.BinaryType())] * with_ids])
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, schema)
