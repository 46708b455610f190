"""Licence scan: gated signature rules, priorities, and suppression of contained detections."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .license_rules import RULES, Rule

#: Phrases that are always reported, with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Lower-cases A-Z and turns every byte that is no word byte into a space.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_BASE = [(frozenset(p.encode().split()), re.compile(rf"(?<= ){p}(?= )".encode()), label) for p, label in BASE.items()]


def _index(rules: Iterable[Rule]) -> tuple[frozenset[bytes], dict[bytes, list[Rule]]]:
    """All gate words, and the rules by the longest word of their gate."""
    rules = list(rules)
    by: dict[bytes, list[Rule]] = {}
    for rule in rules:
        by.setdefault(max(rule.gate, key=lambda w: (len(w), w)), []).append(rule)
    return frozenset(w for r in rules for w in r.gate) | {w for p in BASE for w in p.encode().split()}, by


_WORDS, _BY = _index(RULES)


def fold(raw: bytes) -> list[bytes]:
    """The words of a UTF-8 text: A-Z lower-cased; digits, letters and every byte from 0x80 on."""
    return raw.translate(_FOLD).split()


def detections(norm: bytes, found: frozenset[bytes] | set[bytes]) -> list[tuple[int, int, Rule]]:
    """Spans (bytes of ``norm``) that survive.

    Rules are tried where all words of their gate occur. Detections are taken by priority, then
    length, start and the rules' order; one that lies inside a span taken before is suppressed.
    """
    hits = []
    for word in found:
        for rule in _BY.get(word, ()):
            if rule.gate <= found:
                hits += [(m.start(), m.end(), rule) for m in rule.regex.finditer(norm)]
    hits.sort(key=lambda h: (-h[2].priority, h[0] - h[1], h[0], h[2].order))
    kept: list[tuple[int, int, Rule]] = []
    # Spans taken so far that lie in no other one: starts ascend, and so do ends.
    starts: list[int] = []
    ends: list[int] = []
    for start, end, rule in hits:
        at = bisect_right(starts, start)
        if at and ends[at - 1] >= end:
            continue
        kept.append((start, end, rule))
        low = bisect_left(starts, start)
        high = low + bisect_right(ends[low:], end) if low < len(ends) else low
        starts[low:high], ends[low:high] = [start], [end]
    return sorted(kept, key=lambda h: (h[0], h[1], h[2].order))


def scan(raw: bytes) -> tuple[int, int, int | None, int | None, str, str, float, list[tuple[str, int, int]]]:
    """n_words, n_base, first and last word, base labels, all labels, score, and the detections in words."""
    words = fold(raw)
    found = _WORDS.intersection(words)
    if not found:
        return len(words), 0, None, None, "", "", 0.0, []
    norm = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for gate, regex, label in _BASE:
        if gate <= found:
            for m in regex.finditer(norm):
                places.append(m.start())
                base.add(label)
    kept = detections(norm, found)

    if not places and not kept:
        return len(words), 0, None, None, "", "", 0.0, []
    spaces = list(accumulate((len(w) + 1 for w in words), initial=0))  # where the space before each word stands, and the last one

    def number(at: int) -> int:
        """Words that begin before ``at``, less one: that of a word, or of the space before it, at its own place."""
        return bisect_left(spaces, at) - 1

    labels = base | {rule.label for _, _, rule in kept}
    score = max([rule.relevance / 100 for _, _, rule in kept] + [0.8] * bool(base), default=0.0)
    return (
        len(words), len(places), number(min(places)) if places else None, number(max(places)) if places else None,
        ",".join(sorted(base)), ",".join(sorted(labels)), score,
        [(rule.label, number(a), number(b) + 1) for a, b, rule in kept],
    )


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("detections", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("start_word", T.LongType()), T.StructField("end_word", T.LongType()),
    ]))),
])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with its licence mentions; nothing is shuffled.

    A null text is empty: no words, no labels, score 0. Repeated rows and null doc_ids are kept as
    they are, other columns are ignored, an empty table gives no rows. Time is linear in a text and its
    matches, but for their sorting. ``detections`` holds the
    method's spans in words, end exclusive, in text order.
    """
    span = pa.list_(pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64())]))
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), span]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in kinds]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = scan((text.as_py() or "").encode())
                spans = [{"label": x, "start_word": s, "end_word": e} for x, s, e in got[7]]
                for column, value in zip(out, (doc, *got[:7], spans), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=SCHEMA.names)

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, SCHEMA)
