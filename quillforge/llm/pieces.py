"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi.

The pieces and scores of a model file are taken as a unigram model: of all segmentations the one
with the highest sum of scores wins, on ties the one whose last piece is longest. Characters that
no piece covers become byte pieces, each priced like an unknown character.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
#: What an unknown character costs below the lowest score.
UNKNOWN_PENALTY = 10.0
#: Chunks whose ids a worker keeps, and the longest of them in characters.
CACHE_CHUNKS, CACHE_CHARS = 300_000, 64

#: What a model's normaliser must leave as it is, but for a space in front.
_PROBE = "A  b\u00a0\uff21\ufb01 e\u0301\tx \u2460"


class PieceCoder:
    """Encodes and decodes with the pieces of one model file.

    Where every piece has the space mark only at its front, no piece reaches over the start of a
    word, so words are segmented one by one and kept in a bounded cache; the result is that of the
    whole text. Line feeds are cut off in the same way where no piece holds one.
    """

    def __init__(self, model_path: str, most: int = CACHE_CHUNKS):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        if model.normalize(_PROBE) != SPACE + _PROBE.replace(" ", SPACE):
            raise ValueError("the model's normaliser changes texts; only one that puts a space in front is known here")
        n = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.scores = [model.get_score(i) for i in range(n)]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.unknown = min(self.scores[i] for i in normal) - UNKNOWN_PENALTY
        self.unknown_id, self.most, self.known = model.unk_id(), most, {}
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), i, self.scores[i]))
        self.automaton.make_automaton()
        self.singles = frozenset(self.pieces[i] for i in normal if len(self.pieces[i]) == 1)
        self.local = all(re.fullmatch(f"{SPACE}*[^{SPACE}]*", self.pieces[i]) for i in normal)
        self.lines = not any("\n" in self.pieces[i] for i in normal)
        self.cut = re.compile("\n| *[^ \n]+| +" if self.lines else " *[^ ]+| +").findall
        self.shown = [
            chr(int(p[3:5], 16)) if model.is_byte(i) and int(p[3:5], 16) < 128 else "" if model.is_control(i) else p.replace(SPACE, " ")
            for i, p in enumerate(self.pieces)
        ]
        self.high = frozenset(i for b, i in self.byte_ids.items() if b >= 128)

    def viterbi(self, text: str) -> list[int]:
        """Ids of a text in which spaces are marks already."""
        n = len(text)
        best, back = [0.0] + [-float("inf")] * n, [(1, -1)] * (n + 1)
        if self.singles.issuperset(text):
            for end, value in self.automaton.iter(text):  # along the output links: longest first
                size, _, score = value
                end += 1
                if (s := best[end - size] + score) > best[end]:
                    best[end], back[end] = s, value
        else:
            ending: list[list] = [[] for _ in range(n + 1)]
            for end, value in self.automaton.iter(text):
                ending[end + 1].append(value)
            for e in range(1, n + 1):
                for value in ending[e]:
                    if (s := best[e - value[0]] + value[2]) > best[e]:
                        best[e], back[e] = s, value
                if text[e - 1] not in self.singles and (s := best[e - 1] + self.unknown) > best[e]:
                    best[e], back[e] = s, (1, -1)
        ids: list[int] = []
        e = n
        while e:
            size, i = back[e][:2]
            if i >= 0:
                ids.append(i)
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in text[e - 1].encode("utf-8", "surrogatepass")[::-1]]
            else:
                ids.append(self.unknown_id)
            e -= size
        return ids[::-1]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian uint32 bytes. An empty text has none; others get a space in front."""
        if not text:
            return b""
        text = " " + text.replace(SPACE, " ")
        if not self.local:
            return np.array(self.viterbi(text.replace(" ", SPACE)), "<u4").tobytes()
        chunks, known = self.cut(text), self.known
        if missing := set(chunks).difference(known):
            if len(known) + len(missing) > self.most:
                known.clear()
                missing = set(chunks)
            long = {}
            for chunk in missing:
                ids = np.array(self.viterbi(chunk.replace(" ", SPACE)), "<u4").tobytes()
                (known if len(chunk) <= CACHE_CHARS else long)[chunk] = ids
            if long:  # of no use to other texts
                return b"".join([long[c] if c in long else known[c] for c in chunks])
        return b"".join(map(known.__getitem__, chunks))

    def decode(self, ids: bytes) -> str:
        """The text, without the space in front; byte pieces that are no UTF-8 become U+FFFD."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self.high.isdisjoint(numbers):
            text = "".join(map(self.shown.__getitem__, numbers))
        else:
            raw = b"".join(bytes([int(self.pieces[i][3:5], 16)]) if i in self.high else self.shown[i].encode() for i in numbers)
            text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_CODERS: dict[str, PieceCoder] = {}


def piece_coder(model_path: str) -> PieceCoder:
    """The worker's coder for a model; its automaton and cache serve all tasks of the worker."""
    if model_path not in _CODERS:
        _CODERS.clear()
        _CODERS[model_path] = PieceCoder(model_path)
    return _CODERS[model_path]


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the piece ids of each text (array<int>); null and empty texts have none.

    One row per row, repeated ones and null doc_ids too; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_coder(model_path)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                ids = [np.frombuffer(coder.encode(t.as_py() or ""), "<u4").astype(np.int32) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the text of each row of ids; null ids are an empty text. Rows as in ``encode_pieces``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_coder(model_path)
        for b in batches:
            made = [coder.decode(np.asarray(x.as_py() or [], "<u4").tobytes()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


DIGEST = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_chars", T.LongType()),
    T.StructField("n_ids", T.LongType()),
    T.StructField("n_fallback", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("round_trip", T.BooleanType()),
])


def piece_digest(docs: DataFrame, model_path: str) -> DataFrame:
    """Encode each text, decode the ids again and describe both; one row per row, nothing shuffled.

    ``round_trip`` says that the decoded text is the text with space marks as spaces. Null texts
    are empty; repeated rows and null doc_ids stay; other columns are ignored.
    """
    kinds = [pa.int64()] * 5 + [pa.string(), pa.bool_()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_coder(model_path)
        fallback = np.zeros(len(coder.pieces), bool)
        fallback[list(coder.byte_ids.values())] = True
        for b in batches:
            out: list[list] = [[] for _ in kinds]
            for doc, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = value.as_py() or ""
                ids = coder.encode(text)
                numbers = np.frombuffer(ids, "<u4")
                row = (doc, len(text), len(numbers), int(fallback[numbers].sum()), zlib.crc32(ids), hashlib.sha256(ids).hexdigest(), coder.decode(ids) == text.replace(SPACE, " "))
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=DIGEST.names)

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, DIGEST)
