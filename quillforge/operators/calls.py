"""Model calls: one Arrow operator, a backend protocol, retries, and usage beside every reply."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..batches import bound_batches

#: Attempts of one call and the bounds of the wait between them, in seconds.
ATTEMPTS, WAIT_LEAST, WAIT_MOST = 4, 2.0, 60.0

REPLY = (
    "struct<text:string,error_class:string,error:string,truncated:boolean,model:string,prompt_tokens:bigint,completion_tokens:bigint,"
    "reasoning_tokens:bigint,cached_tokens:bigint,usage_missing:boolean,latency_s:double>"
)
_COUNTS = ("prompt_tokens", "completion_tokens", "reasoning_tokens", "cached_tokens")
_FIELDS = ("text", "error_class", "error", "truncated", "model", *_COUNTS, "usage_missing", "latency_s")
#: Tasks that a step's calls are dealt to, and calls that each of them has under way at once.
TASKS, AT_ONCE = 32, 8
#: Prompts whose replies a task holds before it hands them on.
HELD = 64


@dataclass(frozen=True)
class Reply:
    text: str
    truncated: bool = False
    model: str = "scripted"
    prompt_tokens: int | None = None
    completion_tokens: int | None = None
    reasoning_tokens: int | None = None
    cached_tokens: int | None = None


class ModelError(RuntimeError):
    """``kind`` is ``transient`` (tried again), ``context_length``, ``auth`` or ``other``."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


class Models(Protocol):
    """A backend. It is pickled to the executors, so its replies must not depend on mutable state."""

    def reply(self, role: str, system: str, user: str, attempt: int) -> Reply: ...


@dataclass(frozen=True)
class FunctionModels:
    """Replies from one picklable function of (role, system, user, attempt)."""

    function: Callable[[str, str, str, int], str | Reply]

    def reply(self, role: str, system: str, user: str, attempt: int) -> Reply:
        got = self.function(role, system, user, attempt)
        return got if isinstance(got, Reply) else Reply(got)


def call_once(models: Models, role: str, system: str, user: str, attempt: int, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One answered or failed call; only transient errors are tried again, here and not by Spark."""
    began = time.monotonic()
    for k in range(ATTEMPTS):
        try:
            r = models.reply(role, system, user, attempt)
        except ModelError as e:
            if e.kind == "transient" and k + 1 < ATTEMPTS:
                sleep(min(WAIT_MOST, WAIT_LEAST * 2**k))
                continue
            return dict.fromkeys(_FIELDS) | {"error_class": e.kind, "error": str(e), "truncated": False, "latency_s": round(time.monotonic() - began, 3)}
        return {
            "text": r.text, "error_class": None, "error": None, "truncated": r.truncated, "model": r.model, **{k: getattr(r, k) for k in _COUNTS},
            "usage_missing": r.prompt_tokens is None, "latency_s": round(time.monotonic() - began, 3),
        }
    raise AssertionError


def ask(rows: DataFrame, models: Models, role: str, system: str, user: str, attempt: str | None = None, name: str = "reply", tasks: int = TASKS, at_once: int = AT_ONCE) -> DataFrame:
    """``rows`` with a reply to the prompt in column ``user``; write the result before using it.

    ``system`` is the role's fixed prompt, ``attempt`` an integer column (samples of one prompt differ
    by it). Rows are dealt out evenly to ``tasks`` tasks, since small written tables come back as few
    partitions; each has ``at_once`` calls under way. Replies are handed on in lots of ``HELD``, so a task
    holds few of them; one that is lost and runs again asks its part of the prompts again. A task holds one
    bounded batch as Arrow, whatever its rows; only the prompts of a lot become Python objects.
    """

    bound_batches(rows.sparkSession)
    given = rows.withColumn("__attempt", F.col(attempt).cast("int") if attempt else F.lit(0)).repartition(tasks)
    answer = T.StructType.fromDDL(f"reply {REPLY}")["reply"].dataType
    kind = to_arrow_type(answer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
            for whole in batches:
                prompt, number = whole.schema.get_field_index(user), whole.schema.get_field_index("__attempt")
                kept = [i for i in range(whole.num_columns) if i != number]
                schema = pa.schema([*[whole.schema.field(i) for i in kept], pa.field(name, kind)])
                for start in range(0, whole.num_rows, HELD):
                    b = whole.slice(start, HELD)
                    pairs = zip(b.column(prompt).to_pylist(), b.column(number).to_pylist(), strict=True)
                    replies = list(pool.map(lambda x: call_once(models, role, system, x[0], int(x[1])), pairs))
                    yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], pa.array(replies, kind)], schema=schema)

    return given.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, answer)]))


def usage_rows(replied: DataFrame, role: str, name: str = "reply") -> DataFrame:
    """A usage row for every answered call."""
    r = lambda f: F.col(f"{name}.{f}")
    answered = replied.where(r("error_class").isNull() & F.col(name).isNotNull())
    return answered.select(
        F.lit(role).alias("role"), r("model").alias("model"), *[F.coalesce(r(k), F.lit(0)).alias(k) for k in _COUNTS], r("usage_missing").alias("usage_missing"),
        r("latency_s").alias("latency_s"), F.when(r("truncated"), "length").otherwise("stop").alias("finish_reason"),
    )


def stable_number(*parts: str) -> int:
    """A number from texts, the same in every process."""
    return int.from_bytes(hashlib.md5("\x1f".join(parts).encode()).digest()[:6], "big")
