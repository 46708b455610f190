"""Near-duplicate groups: one-permutation MinHash, banded buckets, star-shaped candidate edges.

1. Equal shingle sets are one node (a 128-bit fingerprint), so exact copies cost a partial sum each.
2. Nodes that share a band with others are candidates; sets of at most 16 shingles, whose few values make
   bands depend on each other, also share exact prefix keys. In each bucket only the edges from its least
   node are tried (a star), on the full sets.
3. What a star can't see is a link between two members that both miss the centre. Buckets that still
   hold more than one component after step 2 go through an exact prefix filter: two sets at
   similarity 0.8 share one of their ``n - ceil(0.8 n) + 1`` first shingles in any common order. The
   order puts shingles that are rare among these nodes first, so a passage that thousands of
   documents share makes no pairs. Only pairs across components are tried.
4. Components of all links; the least doc_id names each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles
from .common import RUN_BYTES, Scratch, fresh_names, runs, utf8_view
from .components import components

#: Candidate doc_ids are broadcast up to this many (8 bytes each, about 32 MB in a hash table), and beyond it
#: the texts are joined by shuffle, once.
BROADCAST_IDS = 1_000_000
#: Counters of the sketch that orders shingles by frequency; its size doesn't depend on the input.
SKETCH_BITS = 18


def _sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    data, offsets = utf8_view(column)
    for a, b in runs(offsets, RUN_BYTES):
        yield from shingles.shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)


def signatures(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n (size of the set), node (its fingerprint), keys (its bands and, for small sets, its exact keys); the last two are null where n is 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, node, keys = [], [], []
            for values in _sets(b.column(1), words):
                n.append(len(values))
                node.append(shingles.fingerprint(values) if len(values) else None)
                keys.append(np.concatenate((shingles.bands(values), shingles.exact_keys(values, percent))).astype(np.int64) if len(values) else None)
            arrays = [b.column(0), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "node", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n long, node binary, keys array<long>"
    )


def node_sets(docs: DataFrame, wanted: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """node and its set (sorted little-endian uint64) for the documents whose doc_ids are wanted.

    The doc_ids are written and counted, and broadcast only when few.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [v for v in _sets(b.column(0), words) if len(v)]
            arrays = [pa.array([shingles.fingerprint(v) for v in made], pa.binary()), pa.array([v.tobytes() for v in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "set"])

    nowhere = F.lit(-(2**63))  # stands for a null doc_id
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), nowhere).alias("key"), F.col("text").cast("string").alias("text"))
    keys = scratch.save(wanted.select(F.coalesce("doc_id", nowhere).alias("key")).distinct())
    if keys.count() <= BROADCAST_IDS:
        keys = F.broadcast(keys)
    return docs.join(keys, "key", "left_semi").select("text").mapInArrow(run, "node binary, set binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.sort(np.concatenate((x, y)))
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield batch.select([0, 1]).filter(pa.array(keep))

    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("x")), sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _alike(a: str, b: str, percent: int):
    """Sets whose sizes differ too much can't be linked."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _sketch(members: DataFrame) -> np.ndarray:
    """Counts of shingles among the members, hashed to a fixed number of counters."""
    size = 1 << SKETCH_BITS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column(0):
                np.add.at(total, (np.frombuffer(x.as_buffer(), "<u8") >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    rows = members.select("set").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[rows["at"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def _prefixes(members: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """token, at, node, n, comp, short for the first shingles of each member, rare ones first.

    A set's first ``n - ceil(p n) + 1`` shingles meet larger sets' ``short`` ones, which are the first
    ``n - ceil(2 p n / (1 + p)) + 1`` only: a partner that is no smaller must share more of the set. So
    the common part of documents that aren't linked isn't among the short ones.
    """
    shared = members.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                b = batch.slice(start, 1000)
                tokens, at, take, sizes, short = [], [], [], [], []
                for i, x in enumerate(b.column(2)):
                    values = np.frombuffer(x.as_buffer(), "<u8")
                    n = len(values)
                    first, few = n - -(-percent * n // 100) + 1, n - -(-2 * percent * n // (100 + percent)) + 1
                    often = shared.value[(values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    tokens.append(values[np.lexsort((values, often))[:first]])
                    at.append(np.arange(first))
                    short.append(np.arange(first) < few)
                    take.append(np.full(first, i))
                    sizes.append(np.full(first, n))
                take = pa.array(np.concatenate(take))
                arrays = [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(at)), b.column(0).take(take), pa.array(np.concatenate(sizes)), b.column(1).take(take), pa.array(np.concatenate(short))]
                yield pa.RecordBatch.from_arrays(arrays, names=["token", "at", "node", "n", "comp", "short"])

    return members.select("node", "comp", "set").mapInArrow(run, "token long, at long, node binary, n long, comp binary, short boolean")


def _across(rows: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Pairs of nodes of different components that share a token, the smaller set by its short prefix.

    A row meets each other component of its token once, then that component's rows of the token. So
    a token of one large component and a few strangers makes as many pairs as it has rows. A pair
    whose shingles from the shared one on can't reach the similarity is left out: through its first
    shared shingle a linked pair always comes.
    """
    mixed = rows.groupBy("token").agg(F.count(F.lit(1)).alias("f"), F.bool_or("short").alias("s")).where("f > 1 and s").select("token")
    rows = scratch.save(rows.join(mixed, "token"))
    least = lambda n, at, other: (n - at) * (100 + percent) >= (n + other) * percent
    smallest = F.ceil(F.col("n") * percent / 100)
    short = rows.where("short")
    groups = short.groupBy("token", F.col("comp").alias("other")).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    meets = rows.join(groups, "token").where((F.col("comp") != F.col("other")) & (F.col("low") <= F.col("n")) & (F.col("high") >= smallest))
    meets = meets.select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"), "other")
    there = short.select("token", F.col("comp").alias("other"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"))
    fits = (F.col("nb") <= F.col("na")) & _alike("na", "nb", percent) & least(F.col("na"), F.col("pa"), F.col("nb")) & least(F.col("nb"), F.col("pb"), F.col("na"))
    pairs = meets.join(there, ["token", "other"]).where(fits)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text).

    The default of four words is op1's contract; ``drop_near_duplicates`` takes five. Two documents are linked when 100 * intersection >= percent * union of their shingle sets;
    component_id is the least doc_id that links reach. Texts without words (null and empty ones too)
    are linked with nothing. Rows that repeat a doc_id are each compared by their own text. A null
    doc_id takes part in links but names no component unless all its doc_ids are null; ``kept`` is
    doc_id = component_id, true where both are null. Other columns are ignored; an empty table gives
    no rows.
    """
    found = _grouped(docs, words, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _grouped(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n, node, root (the group, named by a node), component_id for each row; node and root are null where n is 0."""
    scratch = Scratch(docs.sparkSession)
    keyed = scratch.save(signatures(docs, words, percent))
    signed = scratch.save(keyed.select("doc_id", "n", "node"))
    nodes = scratch.save(
        keyed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("copies"))
    )
    scratch.drop(keyed)
    # Buckets carry the fingerprint's first seven bytes: where two nodes share them, both come back.
    short = F.conv(F.hex(F.substring("node", 1, 7)), 16, 10).cast("long")
    rows = nodes.select(F.explode("keys").alias("key"), short.alias("short"))
    busy = rows.groupBy("key").agg(F.count(F.lit(1)).alias("f")).where("f > 1").select("key")
    buckets = scratch.save(rows.join(busy, "key").join(nodes.select(short.alias("short"), "node", "n", "doc_id"), "short").select("key", "node", "n", "doc_id"))
    sets = scratch.save(node_sets(docs, buckets, words, scratch).join(buckets.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]))

    centres = scratch.save(buckets.groupBy("key").agg(F.min_by(F.struct("node", "n"), "node").alias("c")).select("key", F.col("c.node").alias("a"), F.col("c.n").alias("na")))
    stars = buckets.join(centres, "key").where((F.col("node") != F.col("a")) & _alike("n", "na", percent)).select("a", F.col("node").alias("b")).distinct()
    links = scratch.save(confirmed(scratch.save(stars), sets, percent))

    roots = scratch.save(components(links, scratch))
    placed = buckets.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    placed = scratch.save(placed)
    split = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("key")
    rest = scratch.save(placed.join(split, "key").select("node", "comp").distinct().join(sets, "node"))
    more = confirmed(scratch.save(_across(_prefixes(rest, _sketch(rest), percent), scratch, percent)), sets, percent)
    more = scratch.save(more)
    if more.first() is not None:
        links = links.union(more)
        roots = scratch.save(components(links, scratch))

    # Only sets with copies or links need a lookup; every other document is its own component.
    linked = roots.select("node", "root").union(roots.select(F.col("root").alias("node"), "root")).distinct()
    named = nodes.select("node", "doc_id", "copies").join(linked, "node", "left").where("copies > 1 or root is not null").select("node", F.coalesce("root", "node").alias("root"), "doc_id")
    named = scratch.save(named)
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    lookup = scratch.save(named.join(least, "root").select("node", "root", "component_id", F.lit(True).alias("grouped")))
    scratch.drop_all_but(signed, lookup)
    component = F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id"))
    return signed.select("doc_id", "n", "node").join(lookup, "node", "left").select("doc_id", "n", "node", F.coalesce("root", "node").alias("root"), component.alias("component_id"))


def _with_node(docs: DataFrame, text: str, name: str, words: int) -> DataFrame:
    """``docs`` and ``name``, the fingerprint of each text's set (null without words)."""
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = pa.array([shingles.fingerprint(v) if len(v) else None for v in _sets(b.column(at), words)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, node], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]))


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group, all its columns kept; a row goes only where another one of its group stays.

    The row of the least doc_id stays, null ones last; of several the one of the least fingerprint, then
    of the least text, then of the least other columns. Texts without words (null, empty, white space) are
    in no group: all stay, repeated ones too. The doc_ids that go are written and counted, and broadcast
    only when few; else texts are joined by shuffle. Where doc_ids are null or repeated, rows are told
    apart by their fingerprints. Other columns may have any name; an empty table gives no rows.
    """
    id_, gone_, first_, of_, key_, text_, node_ = fresh_names(docs.columns, "__id", "__gone", "__first", "__of", "__key", "__text", "__node")
    scratch = Scratch(docs.sparkSession)
    found = scratch.save(_grouped(docs.select("doc_id", "text"), words, percent))
    per_id = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("node").isNotNull()).alias("any"))
    shared = scratch.save(per_id.where("any and (rows > 1 or doc_id is null)").select(F.col("doc_id").alias(id_)))
    gone = found.where("node is not null and not doc_id <=> component_id").select(F.col("doc_id").alias(gone_))
    key = F.col("doc_id").cast("long")

    def lookup(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_IDS else df

    if shared.first() is None:
        return docs.join(lookup(scratch.save(gone.distinct())), key == F.col(gone_), "left_anti")
    ids = lookup(scratch.save(shared.where(F.col(id_).isNotNull())))
    clear = docs.where("doc_id is not null").join(ids, key == F.col(id_), "left_anti")
    clear = clear.join(lookup(scratch.save(gone.distinct())), key == F.col(gone_), "left_anti")
    doubtful = docs.where("doc_id is null").unionByName(docs.where("doc_id is not null").join(ids, key == F.col(id_), "left_semi"))
    doubtful = scratch.save(_with_node(doubtful.select("*", key.alias(key_), F.col("text").cast("string").alias(text_)), text_, node_, words))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    first = found.where("node is not null").groupBy("root").agg(F.min(order).alias("f")).select(F.col("f.doc_id").alias(first_), F.col("f.node").alias(of_))
    stays = doubtful.join(first, F.col(key_).eqNullSafe(F.col(first_)) & (F.col(node_) == F.col(of_)), "left_semi")
    least = F.struct(text_, *[f.name for f in docs.schema.fields if _orderable(f.dataType)])
    stays = stays.groupBy(key_, node_).agg(F.min_by(F.struct(*docs.columns), least).alias(text_)).select(f"{text_}.*")
    return clear.unionByName(stays).unionByName(doubtful.where(F.col(node_).isNull()).select(*docs.columns))
