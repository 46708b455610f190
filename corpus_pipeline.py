"""Corpus pipeline: language identification, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and gives the next one's documents; the last gives pieces of
packed sequences. ``run`` writes every stage's result to the shared scratch folder and reads it again,
so a lost executor never repeats an earlier stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillforge.llm import dedup, language, packing, private
from quillforge.llm.common import Scratch, bound_batches
from quillforge.llm.queries import tokenizer_path
from quillforge.shipping import ship

#: Texts that score less with every language are as far from all of them as letters put together at random.
LEAST_SCORE = 0.2
#: Words of a shingle, and the similarity in percent from which two texts are near-duplicates.
WORDS, PERCENT = 5, 80
#: When a term reveals an entity; see ``quillforge.llm.private``.
DISCLOSURE = private.Disclosure()


def _ready(spark: SparkSession) -> None:
    ship(spark)
    bound_batches(spark)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without letters, or far from every learned language, go."""
    _ready(spark)
    return language.keep_identified(docs, LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the one with the least doc_id. Rows without a twin all stay."""
    _ready(spark)
    return dedup.drop_near_duplicates(docs, WORDS, PERCENT)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that reveal it are replaced by labels; n_chars follows the text."""
    return private.sanitise(docs, DISCLOSURE)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    _ready(spark)
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", remove_personal_data),
    ("packing", pack),
]

#: Languages, components and packing aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.save(docs)
    return docs
