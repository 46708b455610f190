"""Building a dataset: first-wins dedupe, splits by paper, and the manifest."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dedupe_key


def hash_order(seed: int, key: str) -> Column:
    """A shuffle that any engine repeats: the MD5 of seed and key; a null key is the empty text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def first_wins(rows: DataFrame, text: str, order: list[str]) -> DataFrame:
    """One row of each dedupe key: the first in ``order`` (null orders come first, as any value counts).

    Rows are reduced by key (partial minima before the shuffle), so a question that repeats very often
    is no hot group and no text but the key's digest travels. Null and blank texts are one key. Of rows that
    agree in key and order one stays, the least by its text; rows that agree in all columns are one.
    """
    key_, at_ = _free(rows, "__key"), _free(rows, "__at")
    key = F.md5(F.coalesce(dedupe_key(F.col(text)), F.lit("")))
    tie = F.sha1(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    keyed = rows.withColumn(key_, F.struct(key.alias("key"), *order, tie.alias("tie")))
    first = keyed.groupBy(F.col(f"{key_}.key").alias("key")).agg(F.min(key_).alias(at_)).select(at_)
    same = [F.col(f"{key_}.{c}").eqNullSafe(F.col(f"{at_}.{c}")) for c in ("key", *order, "tie")]
    won = keyed.join(first, reduce(and_, same), "left_semi")
    # What agrees in key, order and text still repeats: one row of each, any.
    return won.dropDuplicates([key_]).drop(key_)


def _free(rows: DataFrame, name: str) -> str:
    while name in rows.columns:
        name += "_"
    return name


def paper_counts(rows: DataFrame, paper: str) -> DataFrame:
    return rows.groupBy(paper).agg(F.count(F.lit(1)).alias("n"))


def test_papers(rows: DataFrame, paper: str, n_test: int, seed: int = 42) -> DataFrame:
    """paper and split: whole papers go to ``test`` until it has n_test rows (it may overshoot).

    The window runs over one row a paper.
    """
    counts = paper_counts(rows, paper).withColumn("__h", hash_order(seed, paper))
    before = F.sum("n").over(Window.orderBy("__h", paper).rowsBetween(Window.unboundedPreceding, -1))
    return counts.select(paper, F.when(F.coalesce(before, F.lit(0)) < n_test, "test").otherwise("train").alias("split"))


def split_by_paper(rows: DataFrame, paper: str, n_test: int, seed: int = 42, check: bool = True) -> DataFrame:
    """``rows`` with split; no paper is in both. Needs more rows than ``n_test``. Rows without a paper are one paper."""
    if check and rows.count() <= n_test:
        raise ValueError(f"a test split of {n_test} needs more rows than that")
    own = _free(rows, "__paper")
    papers = test_papers(rows, paper, n_test, seed).withColumnRenamed(paper, own)
    return rows.join(papers, F.col(paper).eqNullSafe(F.col(own))).drop(own)


def split_papers(papers: DataFrame, paper: str, n_train: int, n_val: int, seed: int = 42, check: bool = True) -> DataFrame:
    """paper and split: the first n_val in hash order are ``val``, the next n_train ``train``; others are left out."""
    if check and papers.count() < n_train + n_val:
        raise ValueError(f"{n_train} + {n_val} papers are needed")
    place = F.row_number().over(Window.orderBy("__h", paper))
    ranked = papers.select(paper).withColumn("__h", hash_order(seed, paper)).orderBy("__h", paper).limit(n_train + n_val)
    return ranked.withColumn("__n", place).select(paper, F.when(F.col("__n") <= n_val, "val").otherwise("train").alias("split"))


def minibatch(papers: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """At most k rows without replacement, the same ones for one seed."""
    return papers.orderBy(hash_order(seed, key), key).limit(k)


def union_runs(runs: list[DataFrame]) -> DataFrame:
    """All rows of all runs, with run_ord in the order given."""
    out = None
    for i, run in enumerate(runs):
        own = run.withColumn("run_ord", F.lit(i))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        raise ValueError("no runs")
    return out


def manifest(split: DataFrame, paper: str, seed: int) -> DataFrame:
    """One row: counts of either split, the seed, and the sorted papers of the test split."""
    return split.agg(
        F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"), F.lit(seed).alias("seed"),
        F.sort_array(F.collect_set(F.when(F.col("split") == "test", F.col(paper)))).alias("test_papers"),
    )


def replicate(papers: DataFrame, k: int) -> DataFrame:
    """Each row k times, with its sample number."""
    return papers.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("sample"))


def must_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join in which every key of ``left`` must be found; a missing one fails the job."""
    marked = right.withColumn("__there", F.lit(True))
    joined = left.join(marked, key, "left")
    return joined.where(F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit("unknown id: "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)).drop("__there")
