"""Runs from end to end: papers to filtered questions on disk, and prompts to better ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import Checkpoints
from ..operators.calls import Models, usage_rows
from ..operators.metrics import run_summary
from ..sources import readers, sinks
from .inner_loop import LoopConfig, Meter, Shape, final_filter, run_inner_loop
from .prompts import PLAIN, PromptSet


def usage_log(path: str) -> Meter:
    """A meter that appends a usage row for each answered call to a folder of JSON lines."""

    def meter(replied: DataFrame, role: str) -> None:
        sinks.append_jsonl(usage_rows(replied, role), path)

    return meter


def run_questions(spark: SparkSession, papers: str | DataFrame, models: Models, out: str, cfg: LoopConfig = LoopConfig(), prompts: PromptSet = PLAIN, shape: Shape = Shape(), limit: int | None = None) -> dict:
    """Read papers (a folder, or a table with paper_id, title and text), run the loop and the filter, and write everything below ``out``.

    Gives the counts of what was written and the run's summary.
    """
    saved, meter = Checkpoints(spark), usage_log(f"{out.rstrip('/')}/usage.jsonl")
    table = readers.read_papers(spark, papers, limit) if isinstance(papers, str) else papers
    table = saved.save(table.select("paper_id", "title", "text"), "read")
    rounds = saved.save(run_inner_loop(table, models, cfg, prompts, meter), "rounds")
    verdicts = final_filter(rounds.where("accepted"), table, models, True, prompts, shape, cfg.infra_retries, meter)
    qa = rounds.where("accepted").select("paper_id", "qa")
    judged = saved.save(verdicts.join(qa, "paper_id"), "judged")
    counts = sinks.write_run(rounds, judged, out)
    cut = lambda c: F.coalesce(F.size(F.filter(c, lambda s: s["truncated"])), F.lit(0))
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    shown = rounds.select("outcome", size("weak_samples").alias("weak_n"), cut("weak_samples").alias("weak_cut"), size("strong_samples").alias("strong_n"), cut("strong_samples").alias("strong_cut"))
    done = table.select("paper_id").join(rounds.groupBy("paper_id").agg(F.bool_or("accepted").alias("accepted")), "paper_id", "left").join(judged.select("paper_id", "passed"), "paper_id", "left")
    done = done.select("paper_id", F.coalesce("accepted", F.lit(False)).alias("accepted"), F.coalesce("passed", F.lit(False)).alias("final"))
    return {**counts, **run_summary(shown, done).first().asDict()}
