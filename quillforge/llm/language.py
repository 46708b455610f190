"""Language identification by rank-order profiles and out-of-place distance.

A profile is a ranked list of the most frequent n-grams (one to three letters, word ends marked). A
document's own profile is compared to each language's: every n-gram costs the difference of its two
ranks, or the profile's length where the language hasn't got it. The nearest language wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh_names

#: N-grams of a language's and of a document's profile.
PROFILE, DOC_PROFILE = 400, 300
#: Text (in code points) whose n-grams a training task counts at once, and n-grams it holds before it hands them on.
RUN_CHARS, HOLD = 250_000, 300_000
#: Languages whose profiles are one table (PROFILE rows each; its ranks take 2 bytes a row and language), and
#: tables that are broadcast together. Where there are more, texts pass one step more for each further lot.
GROUP, AT_ONCE = 100, 10

_LETTERS: np.ndarray | None = None


def _letters(points: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)
    out = _LETTERS[np.minimum(points, 0xFFFF)]
    if len(points) and points.max() > 0xFFFF:
        high = points > 0xFFFF
        out[high] = [chr(c).isalpha() for c in points[high]]
    return out


def gram_runs(text: str, most: int = RUN_CHARS) -> Iterator[np.ndarray]:
    """Codes of all n-grams of a text in lower case, for about ``most`` characters at a time; none where it has no letter.

    Runs of other characters are one word end (0). No n-gram spans a word end. N-grams over the edge of
    two runs come with the second.
    """
    low, bits = text.lower(), np.uint64(21)
    last = np.zeros(1, np.uint64)  # what the text so far ends with, at most two
    for at in range(0, max(1, len(low)), most):
        points = np.frombuffer(low[at : at + most].encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _letters(points)
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[:1] |= last[-1] > 0
        new = np.where(letter, points, 0)[keep].astype(np.uint64)
        if not len(new):
            continue
        if at + most >= len(low) and new[-1]:
            new = np.append(new, np.uint64(0))
        x = np.concatenate((last, new))
        y, old = x + np.uint64(1), len(last)
        two = y[:-1] << bits | y[1:]
        three = two[:-1] << bits | y[2:]
        yield np.concatenate((y[old:][new > 0], two[old - 1 :], three[max(0, old - 2) :][x[1:-1][max(0, old - 2) :] > 0]))
        last = x[-2:]


def grams(text: str) -> np.ndarray:
    """All codes of ``gram_runs`` at once."""
    return np.concatenate(list(gram_runs(text)) or [np.empty(0, np.uint64)])


def counted(runs: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and their counts, added up run by run."""
    codes, n = np.empty(0, np.uint64), np.empty(0, np.int64)
    for run in runs:
        new, count = np.unique(run, return_counts=True)
        if len(codes):
            new, inverse = np.unique(np.concatenate((codes, new)), return_inverse=True)
            count = np.bincount(inverse, np.concatenate((n, count))).astype(np.int64)
        codes, n = new, count
    return codes, n


def ranked(codes: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """The most frequent of distinct codes, ties by code."""
    return codes[np.lexsort((codes, -count))[:most]]


@dataclass(frozen=True)
class Profiles:
    """Ranks of n-grams by language; -1 where a language's profile hasn't got one."""

    languages: tuple[str, ...]
    codes: np.ndarray
    ranks: np.ndarray
    size: int

    def best(self, own: np.ndarray) -> tuple[str, float]:
        """The language with the least distance to a ranked list (ties: the first by name) and 1 - distance / the most possible."""
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        ranks = np.where((self.codes[at] == own)[:, None], self.ranks[at], -1).astype(np.int64)
        apart = np.where(ranks < 0, self.size, np.minimum(self.size, np.abs(ranks - np.arange(len(own))[:, None])))
        total = apart.sum(axis=0)
        best = int(total.argmin())
        return self.languages[best], 1 - float(total[best]) / (self.size * len(own))


def nearest(groups: list[Profiles], text: str | None) -> tuple[str, float]:
    """The best language of all groups; ``und`` and 0 for a text without letters, or where nothing was learned."""
    own = ranked(*counted(gram_runs(text)), DOC_PROFILE) if text else ()
    if not len(own):
        return "und", 0.0
    return max((g.best(own) for g in groups if g.languages), key=lambda x: x[1], default=("und", 0.0))  # the first of equal ones


def train_groups(labelled: DataFrame, size: int = PROFILE, group: int = GROUP) -> list[Profiles]:
    """Profiles from all rows of ``labelled`` (text, lang), ``group`` languages a table in the order of their names.

    Rows without a language or letters add nothing. Tasks add up n-grams by language before the shuffle. What
    comes to the driver is ``size`` rows a language, group by group.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: dict[str, list[np.ndarray]] = {}
        waiting: dict[str, int] = {}
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang: str) -> None:
            codes, n = np.unique(np.concatenate(pending.pop(lang)), return_counts=True)
            waiting[lang] = 0
            if lang in held:
                both = np.concatenate((held[lang][0], codes))
                weight = np.concatenate((held[lang][1], n))
                codes, inverse = np.unique(both, return_inverse=True)
                n = np.bincount(inverse, weight).astype(np.int64)
            held[lang] = codes, n

        def flush(lang: str) -> pa.RecordBatch:
            codes, n = held.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

        for b in batches:
            for lang, text in zip(b.column(1).to_pylist(), b.column(0), strict=True):
                for got in gram_runs(text.as_py()):
                    pending.setdefault(lang, []).append(got)
                    waiting[lang] = waiting.get(lang, 0) + len(got)
                    if waiting[lang] >= 3 * RUN_CHARS:
                        add(lang)
                        if len(held[lang][0]) > HOLD:
                            yield flush(lang)
        for lang in list(pending):
            add(lang)
        for lang in list(held):
            yield flush(lang)

    rows = labelled.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size).select("lang", "gram", "rank")
    best = Scratch(labelled.sparkSession).save(best)
    names = [r[0] for r in best.select("lang").distinct().orderBy("lang").collect()]
    return [_profiles(best.where(F.col("lang").between(some[0], some[-1])), some, size) for some in (names[i : i + group] for i in range(0, len(names), group))]


def _profiles(best: DataFrame, languages: list[str], size: int) -> Profiles:
    got = best.toPandas()
    codes = np.unique(got["gram"].to_numpy(np.int64)).astype(np.uint64)
    ranks = np.full((len(codes), len(languages)), -1, np.int16 if size < 2**15 else np.int32)
    number = {x: i for i, x in enumerate(languages)}
    ranks[np.searchsorted(codes, got["gram"].to_numpy(np.int64).astype(np.uint64)), got["lang"].map(number).to_numpy()] = got["rank"].to_numpy()
    return Profiles(tuple(languages), codes, ranks, size)


def train(labelled: DataFrame, size: int = PROFILE) -> Profiles:
    """The profiles of all languages as one table; see ``train_groups``."""
    groups = train_groups(labelled, size, group=2**31)
    return groups[0] if groups else Profiles((), np.empty(0, np.uint64), np.empty((0, 0), np.int16), size)


def _lots(docs: DataFrame, groups: list[Profiles]) -> list:
    """Broadcast variables of ``AT_ONCE`` groups each; one of none where nothing was learned."""
    context = docs.sparkSession.sparkContext
    return [context.broadcast(groups[i : i + AT_ONCE]) for i in range(0, max(1, len(groups)), AT_ONCE)]


def _better(before: tuple[str, float], now: tuple[str, float]) -> tuple[str, float]:
    return now if before[0] == "und" or now[0] != "und" and now[1] > before[1] else before


def predict(docs: DataFrame, groups: list[Profiles]) -> DataFrame:
    """doc_id, lang_pred, score for each row of ``docs`` (doc_id, text); nothing is shuffled."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    lots = _lots(docs, groups)

    def step(shared, last: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                before = zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
                got = [_better(x, nearest(shared.value, t.as_py())) for x, t in zip(before, b.column(1), strict=True)]
                made = [pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())]
                yield pa.RecordBatch.from_arrays([b.column(0), *[b.column(1)] * (not last), *made], names=["doc_id", *["text"] * (not last), "lang_pred", "score"])

        return run

    for i, shared in enumerate(lots):
        last = i == len(lots) - 1
        rows = rows.mapInArrow(step(shared, last), "doc_id long, lang_pred string, score double" if last else rows.schema)
    return rows


def held_out(doc_id: str = "doc_id"):
    """One document in five, by the checksum of its number; a null doc_id counts as the empty text, which is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learn from the rows that aren't held out, predict all.

    ``docs`` has doc_id, text and lang; lang is only read in training. A text that is null, empty or
    without letters is ``und`` with score 0, as is every text where nothing was learned. Equal texts
    get equal predictions. Repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    found = predict(docs, train_groups(docs.where(~held_out()), size, GROUP))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least_score: float = 0.0, size: int = PROFILE) -> DataFrame:
    """``docs`` without the rows whose language can't be told; all columns are kept as they are.

    A row goes when its prediction is ``und`` (null, empty and letterless texts, and all where nothing was
    learned) or scores below ``least_score`` with every language. Repeated rows and null doc_ids are decided
    each by their own text; an empty table gives no rows. Rows are filtered where they are read, so nothing
    is shuffled.
    """
    at = docs.columns.index("text")
    mark = fresh_names(docs.columns, "__score")[0]
    lots = _lots(docs, train_groups(docs.where(~held_out()), size, GROUP))
    rows = docs.withColumn(mark, F.lit(-1.0))

    def step(shared, last: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [nearest(shared.value, t.as_py()) for t in b.column(at)]
                best = [max(x, score if lang != "und" else -1.0) for x, (lang, score) in zip(b.column(b.num_columns - 1).to_pylist(), found, strict=True)]
                if last:
                    fine = pa.array([x >= 0 and x >= least_score for x in best], pa.bool_())
                    yield b.select(range(b.num_columns - 1)).filter(fine)
                else:
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(best, pa.float64())], names=b.schema.names)

        return run

    for i, shared in enumerate(lots):
        last = i == len(lots) - 1
        rows = rows.mapInArrow(step(shared, last), docs.schema if last else rows.schema)
    return rows
