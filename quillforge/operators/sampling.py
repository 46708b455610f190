"""Weighted choice and choices with stable ties."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def boltzmann(rows: DataFrame, key: str, score: str, temperature: float) -> DataFrame:
    """key, p and cum: probabilities exp((score - max) / T), normalised, and their running sum in key order.

    A null score counts as 0. ``rows`` has one row a variant, a population that the driver holds anyway.
    """
    if temperature <= 0:
        raise ValueError("use the best row at temperature 0")
    value = F.coalesce(F.col(score), F.lit(0.0))
    weights = rows.select(key, F.exp((value - F.max(value).over(Window.partitionBy(F.lit(1)))) / temperature).alias("w"))
    total = F.sum("w").over(Window.partitionBy(F.lit(1)))
    so_far = F.sum("w").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return weights.select(key, (F.col("w") / total).alias("p"), (so_far / total).alias("cum"))


def draw(rows: DataFrame, key: str, score: str, temperature: float, rng: random.Random) -> object:
    """One key: by its probability, or at temperature 0 and below one of the best at random. Empty input is an error."""
    if temperature <= 0:
        best = rows.select(F.max(F.coalesce(F.col(score), F.lit(0.0)))).first()[0]
        keys = sorted(r[0] for r in rows.where(F.coalesce(F.col(score), F.lit(0.0)) == best).select(key).collect()) if best is not None else []
        if not keys:
            raise ValueError("nothing to choose from")
        return rng.choice(keys)
    at = rng.random()
    found = boltzmann(rows, key, score, temperature).where(F.col("cum") >= at).orderBy("cum", key).select(key).first()
    if found is None:
        found = rows.orderBy(F.desc(key)).select(key).first()
    if found is None:
        raise ValueError("nothing to choose from")
    return found[0]


def first_max(value: str, score: str, order: Sequence[str]) -> Column:
    """An aggregate: the value at the highest score, the first in ``order`` of equal ones (numeric order columns)."""
    return F.max_by(value, F.struct(F.col(score), *[-F.col(c) for c in order]))


def first_min(value: str, score: str, order: Sequence[str]) -> Column:
    return F.min_by(value, F.struct(F.col(score), *[F.col(c) for c in order]))


def best_variant(variants: DataFrame, mean: str, order: str) -> DataFrame:
    """The row with the best mean, a null one counting as -1; the first of equal ones."""
    return variants.orderBy(F.coalesce(F.col(mean), F.lit(-1.0)).desc(), order).limit(1)


def ancestry(variants: DataFrame, most: int = 1000) -> DataFrame:
    """variant_id, ancestor_id, depth for each variant: a recursive walk along parent_id.

    Written as rounds of one join, each of which only carries pairs that still have a parent.
    """
    links = variants.select(F.col("variant_id").alias("__id"), F.col("parent_id").alias("__up"))
    pairs = variants.where("parent_id is not null").select("variant_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("depth"))
    out, depth = pairs, 1
    while depth < most:
        pairs = pairs.join(links, F.col("ancestor_id") == F.col("__id")).where("__up is not null")
        depth += 1
        pairs = pairs.select("variant_id", F.col("__up").alias("ancestor_id"), F.lit(depth).alias("depth"))
        if pairs.first() is None:
            break
        out = out.union(pairs)
    return out
