"""Near-duplicate rows: which go and which stay, small sets, and keys of pairs at exactly the threshold."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillforge.llm import dedup, shingles
from tests.llm.test_operators import near_copies, shingle_set


def brute_rows(rows, k):
    """Rows (doc_id, text, other) that stay: of each group one, by doc_id (null last), then any; rows without words all."""
    sets, parent = [shingle_set(r[1], k) for r in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i) if sets[i] else ("blank", i), []).append(i)
    return sets, list(groups.values())


@pytest.mark.parametrize("seed", [5, 6])
def test_one_row_of_each_group_stays_under_null_and_repeated_ids(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice((None, rng.randint(0, 30))), t, rng.choice(("x", "y"))) for t in near_copies(seed)]
    rows += [(3, "a b c d e f g h", "x"), (5, "a b c d e f g h", "x"), (5, "q r s t u v w", "x"), (None, "k l m n o p", "x"), (None, "z y x w v u", "x"), (40, "", "x"), (40, "", "x"), (None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `__gone` string")
    df = df.select("*", F.lit(1).alias("__node"), F.lit(2).alias("root"), F.create_map(F.lit("k"), F.lit("v")).alias("__key"), F.col("text").alias("n")).repartition(3)
    got = [(r.doc_id, r.text, r["__gone"]) for r in dedup.drop_near_duplicates(df).collect()]
    _, groups = brute_rows(rows, 5)
    assert len(got) == len(groups)
    left = list(got)
    for members in groups:
        there = [rows[i] for i in members if rows[i] in left]
        assert there, [rows[i] for i in members]
        least = min((rows[i][0] for i in members if rows[i][0] is not None), default=None)
        stays = [r for r in there if r[0] == least]
        assert stays, (there, least)
        left.remove(stays[0])
    assert not left
    assert dedup.drop_near_duplicates(df.where("false")).collect() == []


def test_unique_ids_take_the_other_path_and_agree(spark):
    rows = list(enumerate(near_copies(7)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__gone", F.lit(1))
    got = sorted(r.doc_id for r in dedup.drop_near_duplicates(df).collect())
    _, groups = brute_rows([(d, t, "") for d, t in rows], 5)
    assert got == sorted(min(g) for g in groups)


def pair_at_the_threshold(rng, n, m):
    """Sets of n and m values whose similarity is the least from 0.8 up, or None."""
    shared = -(-80 * (n + m) // 180)
    if shared > min(n, m) or 100 * shared < 80 * (n + m - shared):
        return None
    values = rng.integers(0, 2**63, n + m - shared, dtype=np.uint64)
    return np.sort(values[:n]), np.sort(np.concatenate((values[n - shared : n], values[n:])))


def test_small_sets_always_share_a_key():
    rng, tried = np.random.default_rng(5), 0
    for n in range(1, 17):
        for m in range(n, 21):
            for _ in range(20):
                if (pair := pair_at_the_threshold(rng, n, m)) is not None:
                    a, b = (set(shingles.exact_keys(x, 80).tolist()) for x in pair)
                    assert a & b and len(a) <= 5
                    tried += 1
    assert tried > 500 and not len(shingles.exact_keys(np.arange(21, dtype=np.uint64), 80))


def test_bands_of_single_shingles_and_of_pairs_just_above_small():
    one = shingles.bands(np.array([7], np.uint64))
    assert len(one) == shingles.BANDS and len(set(one.tolist())) == shingles.BANDS
    rng, missed = np.random.default_rng(6), 0
    for n in (17, 18, 20, 24, 30, 50):
        for _ in range(200):
            if (pair := pair_at_the_threshold(rng, n, n)) is not None:
                a, b = map(shingles.bands, pair)
                missed += not set(a.tolist()) & set(b.tolist())
    assert missed == 0
