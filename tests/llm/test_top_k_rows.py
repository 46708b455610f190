"""Top-k with repeated rows, several lots of queries, and bounds that carry over from block to block."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillforge.llm import topk


def brute(rows, queries, k):
    out = []
    for q, v in queries:
        left, own = [], False
        for i, w in rows:
            if not own and i == q and v == w:
                own = True
            else:
                left.append((-sum(a * b for a, b in zip(v, w)), i))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(left)[:k])]
    return sorted(out)


@pytest.mark.parametrize("lot", [3, 10_000])
def test_repeated_rows_are_candidates_and_queries_of_their_own(spark, lot):
    rng = random.Random(4)
    rows = [(i, [rng.randint(-9, 9) for _ in range(4)]) for i in range(60)]
    rows += [rows[0], rows[0], (5, [9, 9, 9, 9]), rows[10], (70, [1]), (71, [])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").withColumn("d", F.lit(1)).withColumn("row", F.lit(2)).repartition(4)
    padded = [(i, v + [0] * (4 - len(v))) for i, v in rows]
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 5 = 0"), 5, block=8, lot=lot).collect())
    assert got == brute(padded, [r for r in padded if r[0] % 5 == 0], 5)


def test_queries_that_are_no_rows(spark):
    v = spark.createDataFrame([(i, [i, 1]) for i in range(4)], "vec_id long, v array<long>")
    q = spark.createDataFrame([(2, [1, 0]), (100, [0, 1])], "vec_id long, v array<long>")
    got = sorted(tuple(r) for r in topk.top_k(v, q, 2).collect())
    assert got == [(2, 1, 3, 3), (2, 2, 2, 2), (100, 1, 0, 1), (100, 2, 1, 1)]
    assert topk.top_k(v, q.where("false")).collect() == [] and topk.top_k(v.where("false"), q).collect() == []


def test_a_known_least_score_spares_evaluations():
    rng = np.random.default_rng(1)
    centre = rng.normal(0, 300, (8, 16))
    block = np.floor(np.repeat(centre, 200, axis=0) + rng.normal(0, 5, (1600, 16))).astype(np.int64)
    p = topk.Pivots(np.empty((0, 0)), 16, int((block**2).sum(axis=1).max()))
    p.points = topk._spread(p.lifted(block, query=False), 16)
    q, ids = block[:5], np.arange(1600)
    far_q, far = p.distances(p.lifted(q, query=True)), p.distances(p.lifted(block, query=False))
    plain = topk.best_of_block(q, ids[:5], far_q, block, ids, far, float(p.norm), 5)
    best = np.sort(block @ q.T, axis=0)[-5]
    known = topk.best_of_block(q, ids[:5], far_q, block, ids, far, float(p.norm), 5, best.astype(float))
    assert known[:4] == plain[:4] and known[4] <= plain[4] < 5 * 1600
