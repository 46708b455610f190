"""Training tables: chat prompts by question, and rewards of completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import Checkpoints
from ..functions import json_text, scoring, text
from .calls import Models, ask
from .dataset import must_match


def chat_prompts(questions: DataFrame, system: str, user: Column, order: list[str]) -> DataFrame:
    """prompt (array of role and content) and qa_id (``q0``, ``q1``, ... in order) of each question, beside its columns.

    A training set is as small as its papers' accepted questions, so one window numbers it.
    """
    place = F.row_number().over(Window.orderBy(*order)) - 1
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    prompt = F.array(message("system", F.lit(system)), message("user", user))
    return questions.withColumn("qa_id", F.concat(F.lit("q"), place.cast("string"))).withColumn("prompt", prompt)


def rewards(completions: DataFrame, questions: DataFrame, models: Models, thinking: bool) -> DataFrame:
    """``completions`` (completion_id, qa_id, completion) with reward.

    An empty answer is worth 0 and isn't judged. A judge that fails or stays unusable gives null, which
    averages leave out. A qa_id that isn't in ``questions`` (qa_id, context, question, criteria) fails the job.
    """
    saved = Checkpoints(completions.sparkSession)
    known = must_match(completions, questions.select("qa_id", "context", "question", "criteria"), "qa_id")
    answered = known.withColumn("answer", text.answer_text(F.col("completion"), thinking))
    prompt = F.concat_ws("\n\n", "context", "question", "answer", json_text.prompt_json(F.col("criteria")))
    to_judge = answered.where("answer <> ''").select("completion_id", "criteria", prompt.alias("prompt"))
    replied = saved.save(ask(to_judge, models, "judge", "Grade each criterion from 0 to 1.", "prompt"), "judged")
    scores = scoring.usable_scores(json_text.extract_json(F.col("reply.text")), F.size("criteria"))
    graded = replied.withColumn("scores", scores).select(
        "completion_id", F.when(F.col("scores").isNotNull(), scoring.rubric_score(F.col("scores"), F.transform("criteria", lambda c: c["weight"]))).alias("graded")
    )
    joined = answered.join(graded, "completion_id", "left")
    return joined.select(*completions.columns, F.when(F.col("answer") == "", F.lit(0.0)).otherwise(F.col("graded")).alias("reward"))
