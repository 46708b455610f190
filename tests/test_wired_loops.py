"""The loops end to end with scripted models: an edit that changes the scores, outputs on disk, usage, digests, prompts."""

import json

import pytest
from pyspark.sql import functions as F

from quillforge.functions import html, json_text, text
from quillforge.operators import calls, dataset, digest
from quillforge.plans import config, inner_loop, outer_loop, prompts, run
from quillforge.sources import readers
from tests.test_inner_loop import VERDICT, question


def models(role, system, user, attempt):
    """The challenger writes a good question only when its instructions say so; all else is fixed."""
    usage = {"prompt_tokens": 10, "completion_tokens": 2, "reasoning_tokens": 1}
    if role == "challenger":
        return calls.Reply(question("Q-good" if "hard" in system else "Q-easy"), **usage)
    if role == "quality_verifier":
        return calls.Reply(json.dumps(VERDICT), **usage)
    if role == "judge":
        weak = "weak says" in user
        full = [1] * 7 + [0] * 3
        half = [0.5] * 7 + [0] * 3
        return calls.Reply(json.dumps({"per_criterion": full if "Q-easy" in user else half if weak else [1] * 6 + [0] * 4, "feedback": "seen"}), **usage)
    if role == "meta_optimizer":
        if "You study" in system:
            assert "weak_avg=1.00" in user and "Reference answer: SECRET" in user and "=== Session 1 | paper p" in user
            return calls.Reply("the questions are too easy", **usage)
        edit = prompts.PLAIN.texts["challenger_system"].replace("research", "very hard research") if "too easy" in user else "x"
        return calls.Reply(f"<<<rationale>>>\nharder\n<<<end>>>\n<<<challenger_system>>>\n{edit}\n<<<end>>>", **usage)
    return calls.Reply("weak says" if role == "weak_solver" else "strong says", **usage)


SEED = prompts.PromptSet({**prompts.PLAIN.texts, "challenger_system": prompts.PLAIN.texts["challenger_system"].replace("hard ", "")}, prompts.PARSER_KEYS)


def test_an_edit_of_the_prompts_changes_the_scores(spark, tmp_path):
    papers = spark.createDataFrame([(f"p{i}", f"T{i}", "text") for i in range(6)], "paper_id string, title string, text string")
    backend = calls.FunctionModels(models)
    meta = config.Meta(iterations=1, n_train=3, n_val=2, minibatch=2, samples_per_paper=2, temperature=0.0)
    usage = str(tmp_path / "usage.jsonl")
    sessions = outer_loop.inner_loop_sessions(backend, SEED, inner_loop.LoopConfig(max_iterations=1, samples=1), meter=run.usage_log(usage))
    got = outer_loop.run_outer_loop(papers, SEED, sessions, *outer_loop.model_agents(backend), meta, out_dir=str(tmp_path / "meta"))
    entry = got.log[0]
    assert (entry["status"], entry["parent_score"], entry["child_score"], entry["changed"], entry["rationale"]) == ("accepted", 0.0, 1.0, ["challenger_system"], "harder")
    base = tmp_path / "meta"
    assert json.loads((base / "history.jsonl").read_text())["status"] == "accepted"
    assert [v["variant_id"] for v in json.loads((base / "population.json").read_text())] == ["seed", "v1"]
    assert "+Write a hard very hard" in (base / "variants/v1/diff.patch").read_text() and prompts.PromptSet.load_checked(base / "variants/v1/prompts").texts["challenger_system"] != SEED.texts["challenger_system"]
    child = [json.loads(x) for x in (base / "iterations/001/val_child.jsonl").read_text().splitlines()]
    assert len(child) == 4 and all(s["passed"] and s["final_filter"]["passed"] and s["rounds"][0]["outcome"] == "accepted" for s in child)
    assert (base / "iterations/001/analysis.md").read_text() == "the questions are too easy\n"
    by_role = {r.role: (r["count"], r.r) for r in readers.read_usage(spark, [usage]).groupBy("role").agg(F.count(F.lit(1)).alias("count"), F.sum("reasoning_tokens").alias("r")).collect()}
    assert by_role["challenger"] == (10, 10) and by_role["weak_solver"] == (10, 10) and by_role["strong_solver"] == (4, 4)


def test_a_whole_run_is_written(spark, tmp_path):
    papers = spark.createDataFrame([("a", "A", "text"), ("b", "B", "text")], "paper_id string, title string, text string")
    got = run.run_questions(spark, papers, calls.FunctionModels(models), str(tmp_path / "out"), inner_loop.LoopConfig(max_iterations=2, samples=2))
    assert (got["rounds"], got["accepted"], got["final"], got["papers"], got["accept_yield"]) == (2, 2, 2, 2, 1.0)
    assert spark.read.json(str(tmp_path / "out/final_qa.jsonl")).count() == 2 and spark.read.json(str(tmp_path / "out/usage.jsonl")).count() > 10


def test_rounds_as_the_analyser_reads_them(spark):
    papers = spark.createDataFrame([("a", "A", "text")], "paper_id string, title string, text string")
    rounds = inner_loop.run_inner_loop(papers, calls.FunctionModels(models), inner_loop.LoopConfig(max_iterations=2, samples=2), SEED)
    rows = rounds.withColumn("shown", digest.session_round(5)).orderBy("iteration").collect()
    assert rows[0].detail == "weak_avg=1.00 weak_max=1.00; judge: seen"
    lines = rows[0].shown.split("\n")
    assert lines[:6] == ["--- Round 0 | too_easy ---", "Type: t | tags: s", "Context: ctx", "Question: Q-easy", "Reference answer: SECRET", "Verifier: PASS. ok"]
    assert lines[6] == "Scores: weak_avg=1.00 weak_max=1.00; weak_avg; weak_max" and lines[8] == "  [1] +3 | weak 1.0 1.0 | strong - | point 0"
    assert lines[-4:] == ["  #1 score 1.00: weak  [... 4 more chars]", "     judge: seen", "  #2 score 1.00: weak  [... 4 more chars]", "     judge: seen"]


def test_prompt_columns_and_blocks(spark, tmp_path):
    row = spark.range(1).select(prompts.rendered("$a ${b} $$x $other $a", a=F.lit("$b"), b=F.lit(None).cast("string")).alias("t")).first()
    assert row.t == "$b  $x $other $b"
    assert prompts.blocks("x\n<<<a>>>\n1\n2\n\n<<<end>>> tail\n<<<b>>>\n<<<end>>>\n<<<c>>>\nno end") == {"a": "1\n2"}
    prompts.PLAIN.save(tmp_path)
    assert prompts.PromptSet.load_checked(tmp_path).texts == prompts.PLAIN.texts
    assert set(prompts.MUTABLE) == {"challenger_system", "challenger_first", "challenger_refine", "qv_system"}
    with pytest.raises(ValueError, match="lost"):
        prompts.PLAIN.edited("<<<qv_system>>>\nonly this\n<<<end>>>")


def test_dedupe_and_split_with_nulls_and_repeats(spark):
    rows = [(None, "Q one", "p1"), (1, "q  ONE", "p1"), (1, "other", None), (1, "other", None), (2, None, "p2"), (3, " ", "p2"), (2, "third", None)]
    df = spark.createDataFrame(rows, "run int, question string, paper string").withColumn("__key", F.lit(1))
    got = sorted((str(r.run), str(r.question), str(r.paper)) for r in dataset.first_wins(df, "question", ["run"]).collect())
    assert got == [("1", "other", "None"), ("2", "None", "p2"), ("2", "third", "None"), ("None", "Q one", "p1")]
    split = dataset.split_by_paper(df, "paper", 3)
    assert split.count() == len(rows) and split.columns == [*df.columns, "split"]
    assert len({r.split for r in split.where("paper is null").collect()}) == 1


@pytest.mark.parametrize(("status", "said", "want"), [
    (400, "This model's Maximum Context Length is 10", "context_length"), (400, "context_length_exceeded", "context_length"), (400, "the maximum model length", "context_length"), (413, "", "context_length"), (404, "context length", "other"),
    (500, "context length", "transient"), (502, "upstream error 400: prompt is too long", "context_length"), (502, "upstream error 401", "auth"), (503, "upstream error 429", "transient"), (401, "", "auth"), (403, "x", "auth"), (408, "", "transient"),
    (409, "", "transient"), (429, "", "transient"), (422, "rate limit", "other"), (None, "Connection error.", "transient"), (None, None, "transient"),
])
def test_error_classes_are_one_rule(spark, status, said, want):
    row = spark.createDataFrame([(status, said)], "s int, m string").select(text.error_class(F.col("s"), F.col("m")).alias("c")).first()
    assert row.c == want == text.classify(status, said)


def test_deep_and_long_replies_and_pages():
    assert json_text.extract("{" * 400_000 + "[" * 400_000) is None and json_text.extract('{"a": [' * 100_000) is None
    assert json_text.balanced('"{" then {"a": 1}') == '{"a": 1}'
    assert json_text.fenced("```[1} ```json\n{\"a\": [1]}\n```") == '{"a": [1]}'
    assert html.to_markdown("<article>" + "<div>" * 100_000 + "x", "t", "") == "# t\n\nx\n"
    assert html.to_markdown("<article>" + "<p>x" * 1000, "t", "").count("x") == 1000
    assert html.to_markdown("<article><ul><li>a<li>b</ul>", "t", "") == "# t\n\n* a\n* b\n"


def test_generation_settings_reach_both_solvers():
    made = config.from_dict({"roles": {"weak_solver": {"model": "w"}, "strong_solver": {"model": "s"}, "judge": {"model": "j", "top_p": 0.5}}, "solver_generation": {"thinking": True, "max_tokens": 9, "temperature": 0.3, "top_k": 20}})
    assert [(made.roles[r].thinking, made.roles[r].max_tokens, made.roles[r].top_k, made.roles[r].model) for r in config.SOLVERS] == [(True, 9, 20, "w"), (True, 9, 20, "s")]
    assert made.roles["judge"].max_tokens == config.FILE_MAX_TOKENS
    from quillforge.sources.http_models import HttpModels

    body = HttpModels("http://x", made.roles).request("weak_solver", "s", "u")
    assert (body["top_k"], body["max_tokens"], "top_p" in body) == (20, 9, False)
    with pytest.raises(ValueError, match="missing"):
        config.from_dict({"solver_generation": {"thinking": True}})
