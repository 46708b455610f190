"""The registered queries and their SQL twins.

The tables have no rubrics, so operators run on stand-ins: order lines are rubric criteria or solver
samples of an order, events are calls and sessions of a user, documents are questions and their
sources papers, labels are verifier verdicts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import Checkpoints
from ..functions import gates, html, json_text, scoring, text, verdict
from ..operators import dataset, digest, history, metrics, rewards, sampling
from ..shipping import ship
from ..sources import readers, sinks
from . import inner_loop, prompts


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _r(column, places: int = 6):
    return F.round(column, places)


def rubric_score(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    weight = F.when(F.col("l_returnflag") == "R", -1).otherwise(1) * (F.col("l_partkey") % 10 + 1)
    return lines.groupBy("l_orderkey").agg(_r(scoring.rubric_score_rows(F.col("l_discount") * 10, weight)).alias("score"))


def rubric_score_arrays(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    weight = F.when(F.col("l_returnflag") == "R", -1).otherwise(1) * (F.col("l_partkey") % 10 + 1)
    per = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_discount") * 10).alias("s"), weight.alias("w")))).alias("c"))
    return per.select("l_orderkey", _r(scoring.rubric_score(F.transform("c", lambda x: x["s"]), F.transform("c", lambda x: x["w"]))).alias("score"))


def _gate_inputs(lines: DataFrame) -> DataFrame:
    """Means are rounded: in which order an engine adds must not decide at a threshold."""
    weak, score = F.col("l_linestatus") == "O", F.col("l_discount") * 10
    of = lambda flag: F.when(F.col("l_linestatus") == flag, score)
    return lines.groupBy("l_orderkey").agg(
        _r(F.avg(of("O")), 9).alias("weak_avg"), F.max(of("O")).alias("weak_max"), F.count_if(weak & (score == 0)).alias("weak_zeros"), _r(F.avg(of("F")), 9).alias("strong_avg"),
    )


def outcome_counts(spark, sf_dir):
    per = _gate_inputs(read(spark, sf_dir, "lineitem"))
    outcome = gates.gate_outcome(F.col("weak_avg"), F.col("weak_max"), F.col("weak_zeros"), F.col("strong_avg"))
    return metrics.outcome_counts(per.select(outcome.alias("outcome")))


def gate_reasons(spark, sf_dir):
    per = _gate_inputs(read(spark, sf_dir, "lineitem"))
    weak = gates.weak_check(F.col("weak_avg"), F.col("weak_max"), F.col("weak_zeros"))
    strong = gates.strong_check(F.col("weak_avg"), F.col("strong_avg"))
    return per.select(
        "l_orderkey", F.array_join(weak["reasons"], ",").alias("weak_reasons"), F.array_join(strong["reasons"], ",").alias("strong_reasons"), _r(strong["gap"]).alias("gap"),
    )


def mean_best_at_k(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_discount") * 10).alias("score"), (F.col("l_returnflag") == "R").alias("infra"), (F.col("l_tax") > 0.06).alias("cut"))
    out = metrics.at_k(lines, "l_orderkey", "score", "infra", "cut")
    return out.select("n", "left_out", *[_r(F.col(c)).alias(c) for c in ("mean_at_k", "best_at_k", "truncation_rate")])


def plain_averages(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").withColumn("score", F.when(F.col("l_returnflag") != "R", F.col("l_discount") * 10))
    return metrics.plain_averages(lines, "l_orderkey", "l_linestatus", "score").withColumn("avg_score", _r(F.col("avg_score")))


def _calls(spark, sf_dir) -> DataFrame:
    events = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        F.col("event_type").alias("role"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), k.alias("prompt_tokens"), (k * 2).alias("completion_tokens"),
        F.when(k % 2 == 0, k).alias("reasoning_tokens"), F.lit(None).cast("bigint").alias("cached_tokens"), (k == 0).alias("usage_missing"), F.col("value").alias("latency_s"), "event_id",
    )


def usage_by_role(spark, sf_dir):
    return metrics.usage_totals(_calls(spark, sf_dir), "event_id").withColumn("latency_s", _r(F.col("latency_s"), 3))


def session_score(spark, sf_dir):
    kind = F.col("event_type")
    return metrics.session_scores(read(spark, sf_dir, "events"), "user_id", kind == "purchase", kind != "error").withColumn("score", _r(F.col("score")))


def stopped_sessions(spark, sf_dir):
    last = read(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("stopped_by"))
    return last.where(F.col("stopped_by") == "error")


def dedupe_questions(spark, sf_dir):
    return dataset.first_wins(read(spark, sf_dir, "documents"), "text", ["doc_id"]).select("doc_id")


def split_by_paper(spark, sf_dir):
    return dataset.split_by_paper(read(spark, sf_dir, "documents").select("doc_id", "source"), "source", 100).select("doc_id", "split")


def split_train_val(spark, sf_dir):
    return dataset.split_papers(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", n_train=50, n_val=25)


def split_manifest(spark, sf_dir):
    split = dataset.split_by_paper(read(spark, sf_dir, "documents").select("doc_id", "source"), "source", 100)
    return dataset.manifest(split, "source", 42).withColumn("test_papers", F.array_join("test_papers", ","))


def length_window_sha(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where(F.length("text").between(200, 200_000))
    return docs.select("doc_id", F.length("text").cast("long").alias("chars"), text.sha12(F.col("text")).alias("sha12"))


def snippet_300(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


def clip_answer(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.clip(F.col("text"), 200).alias("clipped"))


def blank_questions(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(~text.is_blank(F.col("text"))).select("doc_id")


def verdict_gate(spark, sf_dir):
    """Labels stand for the verifier's tokens: an odd spelling passes, anything else fails closed."""
    labels = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    say = lambda cond, good, bad: verdict.token(F.when(cond, F.lit(good)).otherwise(F.lit(bad)))
    tokens = {
        "check_1_verdict": say(F.col("toxic") == 0, " no_leakage ", "LEAKAGE"), "check_2_verdict": say(F.col("quality") == 1, "good", "BAD"),
        "check_3_verdict": verdict.token(F.when(F.col("lang") != "es", F.lit("PASS"))), "check_4_verdict": verdict.token(F.lit("CONSISTENT")),
    }
    made = verdict.judge_tokens(tokens, say(F.col("lang") != "fr", "pass", "FAIL"))
    return labels.select("doc_id", made["passed"].alias("passed"), F.array_join(made["issues"], ",").alias("issues"))


def rubric_shape_issues(spark, sf_dir):
    per = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") != "R").cast("int").alias("p"), F.count(F.lit(1)).cast("int").alias("n"))
    return per.select("l_orderkey", F.array_join(verdict.rubric_shape(F.col("p"), F.col("n"), 3, 1, 4, 7), ",").alias("issues"))


def criterion_checks(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    c = F.struct(F.col("l_linestatus").alias("a"), F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("criterion"), (F.col("l_partkey") % 25 - 12).cast("int").alias("weight"), F.when(F.col("l_returnflag") == "R", "negative").otherwise("positive").alias("category"))
    return lines.groupBy("l_orderkey").agg(F.count_if(verdict.criterion_valid(c)).alias("valid"), F.count(F.lit(1)).alias("total"))


def history_text(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return history.ordered_text(rows, "conv_id", ["turn"], F.concat(F.lit("- Q: "), F.col("text")), "|", "history")


def failure_history(spark, sf_dir):
    """Whole rendered histories: turns are attempts, their mode by role."""
    rows = read(spark, sf_dir, "conversations")
    mode = F.when(F.col("role") == "user", "too_easy").when(F.col("role") == "assistant", "failed_on_strong").otherwise("failed_qv")
    attempts = rows.select("conv_id", F.col("turn").alias("seq"), mode.alias("mode"), F.col("text").alias("question"), F.concat(F.lit("turn="), F.col("turn").cast("string")).alias("detail"))
    return history.render_history(attempts, "conv_id")


def html_title(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"))


def listing_ids(spark, sf_dir):
    url = F.concat(F.lit("http://host/abs/"), (F.col("page_id") % 7).cast("string"), F.lit("."), F.col("page_id").cast("string"), F.lit("v2"))
    return read(spark, sf_dir, "pages").select("page_id", text.file_id(text.listing_id(url)).alias("file_id"))


def boltzmann_weights(spark, sf_dir):
    brands = read(spark, sf_dir, "part").groupBy("p_brand").agg((F.avg("p_retailprice") / 1000).alias("s"))
    return sampling.boltzmann(brands, "p_brand", "s", 0.1).select("p_brand", _r(F.col("p")).alias("p"), _r(F.col("cum")).alias("cum"))


def first_tie_argmax(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    return lines.groupBy("l_orderkey").agg(sampling.first_max("l_linenumber", "l_discount", order).alias("best"), sampling.first_min("l_linenumber", "l_discount", order).alias("worst"))


def best_variant(spark, sf_dir):
    brands = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.max("p_size").cast("double").alias("m"))
    return sampling.best_variant(brands, "m", "p_brand").select("p_brand", "m")


def sample_replication(spark, sf_dir):
    return dataset.replicate(read(spark, sf_dir, "embeddings").select("vec_id"), 3)


def running_parent_mean(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return metrics.running_mean(orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_orderkey", _r(F.col("mean_so_far")).alias("mean_so_far"))


def accepted_children(spark, sf_dir):
    """Orders whose price is strictly above their customer's mean so far, their own included."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    means = metrics.running_mean(orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice")
    return means.where(F.col("o_totalprice") > F.col("mean_so_far") + 1e-6).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("accepted"))


def papers_without_verdict(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def papers_with_verdict(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


def reward_lookup(spark, sf_dir):
    """Mean reward by question; a judge failure is null and stays out of the mean."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.when(F.col("l_returnflag") != "R", F.col("l_discount") * 10).alias("reward"))
    found = dataset.must_match(lines, read(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey")
    return found.groupBy("p_partkey", "p_brand").agg(_r(F.avg("reward")).alias("reward"), F.count("reward").alias("graded"), F.count(F.lit(1)).alias("completions"))


def last_30_log(spark, sf_dir):
    return history.last_n(read(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"], 30).select("user_id", "event_id")


def run_summary(spark, sf_dir):
    """Users are papers; their events rounds, of which an error is a crash row."""
    events = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    rounds = events.select(
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("outcome"), k.alias("weak_n"), F.least(k, F.lit(2)).alias("weak_cut"), F.lit(0).cast("bigint").alias("strong_n"), F.lit(0).cast("bigint").alias("strong_cut"),
    )
    done = events.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("accepted"), F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 100)).alias("final"))
    out = metrics.run_summary(rounds, done)
    return out.select(*[_r(F.col(c)).alias(c) if c.endswith(("yield", "rate")) else c for c in out.columns])


def judge_normalise(spark, sf_dir):
    """Event values as one-score judge replies: outside the tolerance they are unusable, inside they are clamped."""
    events = read(spark, sf_dir, "events")
    reply = F.concat(F.lit('{"per_criterion": ['), F.round(F.col("value") / 100 - 0.5, 4).cast("string"), F.lit(', "0.5", true]}'))
    return events.select("event_id", _r(scoring.usable_scores(reply, 3)[0]).alias("score"))


def answer_text(spark, sf_dir):
    """Turns as completions whose thinking ends where their role says so."""
    rows = read(spark, sf_dir, "conversations")
    completion = F.when(F.col("role") == "user", F.concat(F.lit("<think>"), F.col("text"))).when(F.col("role") == "assistant", F.concat(F.lit("why</think> "), F.col("text"))).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", text.answer_text(completion, False).alias("answer"), text.split_thinking(completion)["finished"].alias("finished"))


def error_taxonomy(spark, sf_dir):
    # 200 stands for a call that got no answer, so it has no status.
    status = (F.col("event_id") % 6).cast("int")
    code = F.element_at(F.array(*[F.lit(x) for x in (400, 401, 429, 503, 200, 400)]), status + 1)
    message = F.element_at(F.array(*[F.lit(x) for x in ("maximum context length is 10", "no key", "slow down", "", "Connection error.", "bad field")]), status + 1)
    return read(spark, sf_dir, "events").groupBy(text.error_class(F.nullif(code, F.lit(200)), message).alias("error_class")).agg(F.count(F.lit(1)).alias("n"))


def html_to_markdown(spark, sf_dir):
    ship(spark)
    pages = read(spark, sf_dir, "pages")
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    return pages.select("page_id", html.html_to_markdown(F.col("html"), title, "").alias("markdown"))


def extract_json(spark, sf_dir):
    ship(spark)
    rows = read(spark, sf_dir, "conversations")
    reply = F.concat(F.col("text"), F.lit("\n```json\n{\"turn\": "), F.col("turn").cast("string"), F.lit(", \"tags\": [1, 2,],}\n``` done"))
    found = F.try_parse_json(json_text.extract_json(reply))
    return rows.select("conv_id", "turn", F.try_variant_get(found, "$.turn", "bigint").alias("found_turn"), F.size(F.try_variant_get(found, "$.tags", "array<int>")).alias("n_tags"))


def inner_loop_scripted(spark, sf_dir):
    """Documents as papers through the whole generate, verify, answer and judge loop with scripted models."""
    ship(spark)
    docs = read(spark, sf_dir, "documents")
    papers = docs.select(F.col("doc_id").cast("string").alias("paper_id"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), "text")
    rounds = inner_loop.run_inner_loop(papers, inner_loop.ScriptedModels(), inner_loop.LoopConfig(max_iterations=4, samples=2))
    return rounds.groupBy("iteration", "outcome").agg(F.count(F.lit(1)).alias("n"))


def _written(spark, name: str) -> str:
    """A new folder of the shared checkpoint folder, for queries that go through files."""
    return f"{Checkpoints(spark).base}/{name}"


def stop_outcomes(spark, sf_dir):
    """Users as papers, their events as rounds in order: what stopped them."""
    events = read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))
    return events.select("user_id", gates.stops(F.transform("e", lambda x: x["event_type"])).alias("stopped_by"))


def sample_failures(spark, sf_dir):
    """Order lines as samples: the first technical failure, samples to buy again, and the note on cut-off ones."""
    feedback = F.when(F.col("l_tax") > 0.04, F.concat(F.lit("solver_error: "), F.col("l_linenumber").cast("string"))).otherwise("judge down")
    sample = F.struct("l_linenumber", "l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").alias("infra_error"), feedback.alias("judge_feedback"), (F.col("l_discount") > 0.07).alias("truncated"))
    per = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(sample)).alias("samples"))
    s = F.col("samples")
    return per.select("l_orderkey", gates.first_infra_error(s).alias("first_error"), F.array_join(gates.to_rerun(s).cast("array<string>"), ",").alias("again"), gates.truncation_note(s, "weak").alias("note"))


def jsonl_round_trip(spark, sf_dir):
    """Turns written as JSON lines and read back by their schema."""
    path = _written(spark, "turns.jsonl")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    sinks.write_jsonl(rows, path)
    return readers.read_jsonl(spark, path, "conv_id bigint, turn bigint, role string, text string")


def runs_union(spark, sf_dir):
    """Two runs of questions on disk, read in the order given."""
    base = _written(spark, "runs")
    asked = read(spark, sf_dir, "documents").select(F.col("text").alias("question"), F.col("source").alias("paper_id"), "doc_id")
    for i in (0, 1):
        sinks.write_jsonl(asked.where(F.col("doc_id") % 2 == i).drop("doc_id"), f"{base}/r{i}/final_qa.jsonl")
    return readers.read_runs(spark, [f"{base}/r1", f"{base}/r0"]).groupBy("run_ord", "paper_id").agg(F.count(F.lit(1)).alias("n"))


def usage_logs(spark, sf_dir):
    """Calls written as two usage logs, read as one table and summed by role."""
    base, rows = _written(spark, "usage"), _calls(spark, sf_dir).drop("event_id").withColumn("finish_reason", F.lit("stop"))
    sinks.append_jsonl(rows.where("role <> 'error'"), f"{base}/a.jsonl")
    sinks.append_jsonl(rows.where("role = 'error'"), f"{base}/b.jsonl")
    read_back = readers.read_usage(spark, [f"{base}/a.jsonl", f"{base}/b.jsonl"])
    return metrics.usage_totals(read_back, "model").drop("model").withColumn("latency_s", _r(F.col("latency_s"), 3))


def prompt_render(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    made = prompts.rendered("$name: $$$size, ${brand}/$name; $other $$", name=F.col("p_name"), size=F.col("p_size"), brand=F.col("p_brand"))
    return part.select("p_partkey", made.alias("prompt"))


def challenger_messages(spark, sf_dir):
    """First turns and later ones of the challenger's message; nations stand for papers, their comments' absence for no history."""
    feedback = F.when(F.col("n_nationkey") % 2 == 1, F.concat(F.lit("failed: $task "), F.col("n_name")))
    made = prompts.PLAIN.challenger(F.col("n_name"), F.col("n_nationkey").cast("string"), F.lit("text"), feedback)
    return read(spark, sf_dir, "nation").select("n_nationkey", made.alias("message"))


def _criteria(sf_dir, spark):
    lines = read(spark, sf_dir, "lineitem")
    weight = (F.when(F.col("l_returnflag") == "R", -1).otherwise(1) * (F.col("l_partkey") % 10 + 1)).cast("int")
    c = F.struct(F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("criterion"), weight.alias("weight"), F.when(weight > 0, "positive").otherwise("negative").alias("category"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_discount", c.alias("c"))
    return lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(order)).alias("o"))


def rubric_json(spark, sf_dir):
    """Rubrics as the JSON that prompts show."""
    ship(spark)
    return _criteria(sf_dir, spark).select("l_orderkey", json_text.prompt_json(F.transform("o", lambda x: x["c"])).alias("rubric"))


def criterion_matrix(spark, sf_dir):
    """A row for each criterion of an order with the scores of its two samples; the second lacks its last score."""
    one = F.transform("o", lambda x: x["l_discount"] * 10)
    samples = F.array(F.struct(one.alias("per_criterion")), F.struct(F.slice(one, 1, F.size(one) - 1).alias("per_criterion")))
    rounds = _criteria(sf_dir, spark).select("l_orderkey", F.transform("o", lambda x: x["c"]).alias("criteria"), samples.alias("samples"))
    found = digest.criterion_scores(rounds, "criteria", "samples", ["l_orderkey"])
    return found.select("l_orderkey", F.col("k").alias("k"), "criterion", "weight", _r(F.col("scores")[0]).alias("first"), _r(F.col("scores")[1]).alias("second"))


def reply_verdicts(spark, sf_dir):
    """Labels as verifier replies in JSON: what passes, what is wrong, and feedback with the rubric's issues."""
    labels = read(spark, sf_dir, "labels")
    say = lambda good, a, b: F.when(good, F.lit(a)).otherwise(F.lit(b))
    reply = F.concat(
        F.lit('{"check_1_verdict": "'), say(F.col("toxic") == 0, " no_leakage", "LEAKAGE"), F.lit('", "check_2_verdict": '), say(F.col("quality") == 1, '"Good"', "7"),
        F.lit(', "check_3_verdict": "PASS", "check_3_issues": ["thin"], "check_4_verdict": "CONSISTENT", "overall": "pass", "feedback": "id '), F.col("doc_id").cast("string"), F.lit('"'), say(F.col("doc_id") % 7 > 0, "}", ""),
    )
    v = verdict.verdict(reply)
    return labels.select("doc_id", v["passed"].alias("passed"), F.array_join(v["issues"], ",").alias("issues"), v["feedback"].alias("feedback"))


def round_outcomes(spark, sf_dir):
    """Every event as a round whose steps went wrong by the digits of its number."""
    bit = lambda n: (F.col("event_id") % n == 0)
    gate = F.when(bit(2), "too_easy").when(bit(3), "accepted").otherwise("failed_on_strong")
    made = gates.round_outcome(bit(31), bit(13), bit(17), bit(19), ~bit(7), bit(11), bit(5), gate)
    return read(spark, sf_dir, "events").select("event_id", made.alias("outcome"))


def minibatch_papers(spark, sf_dir):
    return dataset.minibatch(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 20, 7)


def variant_ancestry(spark, sf_dir):
    """Nations as variants: half of a number is its parent."""
    rows = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("variant_id"), F.when(F.col("n_nationkey") > 0, F.floor(F.col("n_nationkey") / 2)).alias("parent_id"))
    return sampling.ancestry(rows)


def child_acceptance(spark, sf_dir):
    """Is a customer's highest price above the mean of all, each rounded to whole units?"""
    price = F.round("o_totalprice").cast("double")
    per = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(price).alias("scores"), F.max(price).alias("child"))
    return per.select("o_custkey", metrics.accepts(F.col("child"), F.col("scores")).alias("accepted"))


def chat_prompt_table(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    made = rewards.chat_prompts(parts, "be brief", F.concat(F.lit("about "), F.col("p_name")), ["p_partkey"])
    return made.select("qa_id", "p_partkey", F.array_join(F.transform("prompt", lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|").alias("prompt"))


def chat_answers(spark, sf_dir):
    """Answers of chat completions whose last message is marked, split or plain by its turn."""
    rows = read(spark, sf_dir, "conversations")
    content = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("so</think> "), F.col("text"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("<think>"), F.col("text"))).otherwise(F.col("text"))
    messages = F.array(F.struct(F.lit("user").alias("role"), F.lit("<think>").alias("content")), F.struct(F.lit("assistant").alias("role"), content.alias("content")))
    return rows.select("conv_id", "turn", text.chat_answer_text(messages, True).alias("answer"))


def paper_titles(spark, sf_dir):
    """The first heading of a text made around each document's source, or its id."""
    body = F.concat(F.lit("intro\n"), F.when(F.col("doc_id") % 3 == 0, "#no heading").otherwise(F.concat(F.lit("  #  "), F.col("source"), F.lit(" \n# second"))))
    return read(spark, sf_dir, "documents").select("doc_id", text.markdown_title(body, F.col("doc_id").cast("string")).alias("title"))


def earlier_questions(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("question"))
    return history.earlier_failures(rows, "conv_id", "turn").select("conv_id", "turn", F.array_join("earlier", ",").alias("earlier"))


def papers_on_disk(spark, sf_dir):
    """Documents as Markdown-like rows through the reader's filters: blank texts are left out, the rest keep their length."""
    docs = read(spark, sf_dir, "documents")
    return docs.where(~text.is_blank(F.col("text"))).select("doc_id", F.length(text.strip(F.col("text"))).alias("chars"))


def session_texts(spark, sf_dir):
    """Users as sessions: what the analyser reads about each, from plain rounds of errors and malformed replies."""
    events = read(spark, sf_dir, "events")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    nothing = lambda ddl: F.lit(None).cast(ddl)
    sample = "array<struct<answer:string,per_criterion:array<double>,weighted_score:double,judge_feedback:string,truncated:boolean>>"
    qa = "struct<question_type:string,skill_tags:array<string>,context:string,question:string,reference_answer:string,criteria:array<struct<criterion:string,weight:int,category:string>>>"
    rounds = events.select(
        F.col("user_id").cast("string").alias("paper_id"), place.cast("int").alias("iteration"), F.when(F.col("event_type") == "error", "error").otherwise("malformed").alias("outcome"), nothing(qa).alias("qa"),
        nothing("struct<passed:boolean,feedback:string,issues:array<string>>").alias("qv_verdict"), nothing(sample).alias("weak_samples"), nothing(sample).alias("strong_samples"),
        *[nothing("double").alias(c) for c in ("weak_avg", "weak_max", "strong_avg", "gap")], nothing("array<string>").alias("reasons"), F.col("event_type").alias("error"),
    )
    sessions = events.select("user_id").distinct().select(
        F.col("user_id").cast("string").alias("session_id"), F.col("user_id").cast("string").alias("paper_id"), F.lit("T").alias("title"), (F.col("user_id") % 2 == 0).alias("passed"),
        F.when(F.col("user_id") % 3 == 0, "crash").alias("stopped_by"), nothing("struct<passed:boolean,issues:array<string>,feedback:string>").alias("final_filter"),
    )
    return digest.session_digests(rounds, sessions)


_SCORES = "CAST(l_discount * 10 AS DOUBLE)"
_GATE = f"""
    WITH g AS (
        SELECT l_orderkey, round(avg(CASE WHEN l_linestatus = 'O' THEN {_SCORES} END), 9) AS wa, max(CASE WHEN l_linestatus = 'O' THEN {_SCORES} END) AS wm,
               sum(CASE WHEN l_linestatus = 'O' AND {_SCORES} = 0 THEN 1 ELSE 0 END) AS z, round(avg(CASE WHEN l_linestatus = 'F' THEN {_SCORES} END), 9) AS sa
        FROM lineitem GROUP BY l_orderkey)
"""
_D = "CAST({} AS DOUBLE)"
_RUBRIC = f"""
    SELECT l_orderkey, round(CASE WHEN pos = 0 THEN 0.0 ELSE greatest(0.0, raw / pos) END, 6) AS score
    FROM (SELECT l_orderkey, sum(CAST(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * (l_partkey % 10 + 1) AS DOUBLE) * {_SCORES}) AS raw,
                 CAST(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_partkey % 10 + 1 END) AS DOUBLE) AS pos
          FROM lineitem GROUP BY l_orderkey)
"""
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_PAPERS = """
    p AS (SELECT source, count(*) AS n, md5(concat('42:', source)) AS h FROM documents GROUP BY source),
    c AS (SELECT source, coalesce(sum(n) OVER (ORDER BY h, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p),
    s AS (SELECT doc_id, d.source, CASE WHEN b < 100 THEN 'test' ELSE 'train' END AS split FROM documents d JOIN c ON d.source = c.source)
"""
_NL = "chr(10) || chr(10)"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_MODE = "CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END"

ORACLES = {
    "rubric_score": _RUBRIC,
    "rubric_score_arrays": _RUBRIC,
    "outcome_counts": f"""{_GATE}
        SELECT CASE WHEN wa IS NULL THEN 'no_weak' WHEN wa > {_D.format(0.65)} OR wm > {_D.format(0.75)} THEN 'too_easy' WHEN z > 0 THEN 'weak_zero'
                    WHEN sa IS NULL OR sa < {_D.format('0.60')} OR sa >= {_D.format(0.95)} OR sa - wa < {_D.format('0.20')} THEN 'failed_on_strong' ELSE 'accepted' END AS outcome,
               count(*) AS n FROM g GROUP BY 1""",
    "gate_reasons": f"""{_GATE}
        SELECT l_orderkey,
               CASE WHEN wa IS NULL THEN 'no weak scores' ELSE concat_ws(',', CASE WHEN wa > {_D.format(0.65)} THEN 'weak_avg' END, CASE WHEN wm > {_D.format(0.75)} THEN 'weak_max' END, CASE WHEN z > 0 THEN 'weak_zero' END) END AS weak_reasons,
               CASE WHEN sa IS NULL THEN 'no strong scores' ELSE concat_ws(',', CASE WHEN sa < {_D.format('0.60')} THEN 'strong_avg_low' END, CASE WHEN sa >= {_D.format(0.95)} THEN 'saturated' END, CASE WHEN sa - wa < {_D.format('0.20')} THEN 'gap' END) END AS strong_reasons,
               round(sa - wa, 6) AS gap FROM g""",
    "mean_best_at_k": f"""
        WITH q AS (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS bad, avg({_SCORES}) AS m, max({_SCORES}) AS b,
                          sum(CASE WHEN l_tax > {_D.format(0.06)} THEN 1 ELSE 0 END) AS cut, count(*) AS k FROM lineitem GROUP BY l_orderkey)
        SELECT count(*) FILTER (bad = 0) AS n, count(*) FILTER (bad > 0) AS left_out, round(avg(m) FILTER (bad = 0), 6) AS mean_at_k,
               round(avg(b) FILTER (bad = 0), 6) AS best_at_k, round(CAST(sum(cut) FILTER (bad = 0) AS DOUBLE) / nullif(sum(k) FILTER (bad = 0), 0), 6) AS truncation_rate FROM q""",
    "plain_averages": f"SELECT l_orderkey, l_linestatus, round(avg(CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE {_SCORES} END), 6) AS avg_score FROM lineitem GROUP BY 1, 2",
    "usage_by_role": f"""
        SELECT event_type AS role, arg_min('m' || CAST(user_id % 3 AS VARCHAR), event_id) AS model, count(*) AS calls, count(*) FILTER ({_K} = 0) AS usage_missing,
               round(sum(value), 3) AS latency_s, CAST(sum({_K}) AS BIGINT) AS prompt_tokens, CAST(sum({_K} * 2) AS BIGINT) AS completion_tokens,
               CAST(sum(CASE WHEN {_K} % 2 = 0 THEN {_K} ELSE 0 END) AS BIGINT) AS reasoning_tokens, CAST(0 AS BIGINT) AS cached_tokens FROM events GROUP BY 1""",
    "session_score": """
        SELECT user_id, total, scored, passed, round(CAST(passed AS DOUBLE) / nullif(scored, 0), 6) AS score, scored > 0 AND scored >= CAST(0.8 AS DOUBLE) * total AS valid
        FROM (SELECT user_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS scored, count(*) FILTER (event_type = 'purchase') AS passed FROM events GROUP BY user_id)""",
    "stopped_sessions": "SELECT user_id, e AS stopped_by FROM (SELECT user_id, arg_max(event_type, row(ts, event_id)) AS e FROM events GROUP BY user_id) WHERE e = 'error'",
    "dedupe_questions": r"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) ORDER BY doc_id) AS n FROM documents) WHERE n = 1",
    "split_by_paper": f"WITH {_PAPERS} SELECT doc_id, split FROM s",
    "split_train_val": """
        SELECT doc_id, CASE WHEN n <= 25 THEN 'val' ELSE 'train' END AS split
        FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('42:', CAST(doc_id AS VARCHAR))), doc_id) AS n FROM documents) WHERE n <= 75""",
    "split_manifest": f"""WITH {_PAPERS}
        SELECT count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test, 42 AS seed,
               (SELECT string_agg(source, ',' ORDER BY source) FROM (SELECT DISTINCT source FROM s WHERE split = 'test')) AS test_papers FROM s""",
    "length_window_sha": "SELECT doc_id, length(text) AS chars, substr(sha256(text), 1, 12) AS sha12 FROM documents WHERE length(text) BETWEEN 200 AND 200000",
    "snippet_300": r"""
        SELECT doc_id, CASE WHEN length(f) <= 300 THEN f ELSE substr(f, 1, 297) || '...' END AS snippet
        FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents)""",
    "clip_answer": f"""
        SELECT conv_id, turn, CASE WHEN length(t) <= 200 THEN t ELSE substr(t, 1, 200) || ' [... ' || CAST(length(t) - 200 AS VARCHAR) || ' more chars]' END AS clipped
        FROM (SELECT conv_id, turn, {_STRIP.format('text')} AS t FROM conversations)""",
    "blank_questions": r"SELECT doc_id FROM documents WHERE regexp_replace(coalesce(text, ''), '\s+', '', 'g') <> ''",
    "verdict_gate": """
        WITH t AS (SELECT l.doc_id, CASE WHEN toxic = 0 THEN 'NO_LEAKAGE' ELSE 'LEAKAGE' END AS a, CASE WHEN quality = 1 THEN 'GOOD' ELSE 'BAD' END AS b,
                          CASE WHEN lang <> 'es' THEN 'PASS' ELSE 'MISSING' END AS c, CASE WHEN lang <> 'fr' THEN 'PASS' ELSE 'FAIL' END AS o
                   FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
        i AS (SELECT doc_id, o, concat_ws(',', CASE WHEN a <> 'NO_LEAKAGE' THEN 'check_1_verdict=' || a END, CASE WHEN b <> 'GOOD' THEN 'check_2_verdict=' || b END,
                     CASE WHEN c <> 'PASS' THEN 'check_3_verdict=' || c END) AS issues FROM t)
        SELECT doc_id, issues = '' AND o = 'PASS' AS passed, CASE WHEN issues = '' AND o <> 'PASS' THEN 'overall=' || o ELSE issues END AS issues FROM i""",
    "rubric_shape_issues": """
        SELECT l_orderkey, concat_ws(',', CASE WHEN p < 3 THEN 'positive' END, CASE WHEN n - p < 1 THEN 'negative' END, CASE WHEN n NOT BETWEEN 4 AND 7 THEN 'total' END) AS issues
        FROM (SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R') AS p, count(*) AS n FROM lineitem GROUP BY l_orderkey)""",
    "criterion_checks": """
        SELECT l_orderkey, count(*) FILTER (length('c' || CAST(l_suppkey AS VARCHAR)) >= 3 AND w BETWEEN -10 AND 10 AND w <> 0 AND (w > 0) = (l_returnflag <> 'R')) AS valid, count(*) AS total
        FROM (SELECT *, l_partkey % 25 - 12 AS w FROM lineitem) GROUP BY l_orderkey""",
    "history_text": "SELECT conv_id, string_agg('- Q: ' || text, '|' ORDER BY turn) AS history FROM conversations WHERE role = 'user' GROUP BY conv_id",
    "failure_history": f"""
        WITH b AS (SELECT conv_id, {_MODE} AS m, string_agg('- Q: ' || text || chr(10) || '  turn=' || CAST(turn AS VARCHAR), chr(10) ORDER BY turn) AS l FROM conversations GROUP BY 1, 2)
        SELECT conv_id, 'PREVIOUSLY FAILED QUESTIONS, grouped by failure mode:' || chr(10) || chr(10) || string_agg(
                   CASE m WHEN 0 THEN 'TOO EASY (the weak solver scored too high)' WHEN 1 THEN 'FAILED ON STRONG (the strong solver did not clear the bar)'
                          ELSE 'FAILED QV (rejected by the quality verifier)' END || ':' || chr(10) || l, chr(10) || chr(10) ORDER BY m) AS history FROM b GROUP BY conv_id""",
    "html_title": "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages",
    "listing_ids": "SELECT page_id, CAST(page_id % 7 AS VARCHAR) || '.' || CAST(page_id AS VARCHAR) AS file_id FROM pages",
    "boltzmann_weights": """
        WITH m AS (SELECT p_brand, avg(p_retailprice) / 1000 AS s FROM part GROUP BY p_brand), w AS (SELECT p_brand, exp((s - max(s) OVER ()) / CAST(0.1 AS DOUBLE)) AS w FROM m)
        SELECT p_brand, round(w / sum(w) OVER (), 6) AS p, round(sum(w) OVER (ORDER BY p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(w) OVER (), 6) AS cum FROM w""",
    "first_tie_argmax": """
        SELECT l_orderkey, arg_max(l_linenumber, row(l_discount, -l_linenumber, -l_partkey, -l_suppkey)) AS best,
               arg_min(l_linenumber, row(l_discount, l_linenumber, l_partkey, l_suppkey)) AS worst FROM lineitem GROUP BY l_orderkey""",
    "best_variant": "SELECT p_brand, CAST(max(p_size) AS DOUBLE) AS m FROM part GROUP BY p_brand ORDER BY m DESC, p_brand LIMIT 1",
    "sample_replication": "SELECT vec_id, CAST(s AS INTEGER) AS sample FROM embeddings, range(3) r(s)",
    "running_parent_mean": "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS mean_so_far FROM orders",
    "accepted_children": """
        SELECT o_custkey, count(*) AS accepted FROM (SELECT o_custkey, o_totalprice AS t, avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM orders)
        WHERE t > m + CAST(1e-6 AS DOUBLE) GROUP BY 1""",
    "papers_without_verdict": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "papers_with_verdict": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "reward_lookup": f"""
        SELECT p_partkey, p_brand, round(avg(CASE WHEN l_returnflag <> 'R' THEN {_SCORES} END), 6) AS reward, count(*) FILTER (l_returnflag <> 'R') AS graded, count(*) AS completions
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "last_30_log": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 30",
    "run_summary": f"""
        WITH d AS (SELECT user_id, bool_or(event_type = 'purchase') AS a, bool_or(event_type = 'purchase' AND value > 100) AS f FROM events GROUP BY user_id),
        x AS (SELECT count(*) AS papers, count(*) FILTER (a) AS accepted, count(*) FILTER (f) AS final FROM d),
        r AS (SELECT count(*) AS rounds, coalesce(sum({_K}), 0) AS wn, coalesce(sum(least({_K}, 2)), 0) AS wc FROM events WHERE event_type <> 'error')
        SELECT papers, accepted, final, round(CAST(accepted AS DOUBLE) / greatest(papers, 1), 6) AS accept_yield, round(CAST(final AS DOUBLE) / greatest(papers, 1), 6) AS final_yield,
               rounds, round(CAST(wc AS DOUBLE) / greatest(wn, 1), 6) AS weak_truncation_rate, CAST(0 AS DOUBLE) AS strong_truncation_rate FROM x, r""",
    "judge_normalise": """
        SELECT event_id, CASE WHEN v BETWEEN CAST(-0.25 AS DOUBLE) AND CAST(1.25 AS DOUBLE) THEN round(greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), v)), 6) END AS score
        FROM (SELECT event_id, round(value / 100 - CAST(0.5 AS DOUBLE), 4) AS v FROM events)""",
    "answer_text": f"""
        SELECT conv_id, turn, CASE WHEN role = 'user' THEN '' ELSE {_STRIP.format('text')} END AS answer, role <> 'user' AS finished FROM conversations""",
    "error_taxonomy": """
        SELECT CASE event_id % 6 WHEN 0 THEN 'context_length' WHEN 1 THEN 'auth' WHEN 5 THEN 'other' ELSE 'transient' END AS error_class, count(*) AS n FROM events GROUP BY 1""",
    "stop_outcomes": "SELECT user_id, CASE WHEN e = 'error' THEN e END AS stopped_by FROM (SELECT user_id, arg_max(event_type, row(ts, event_id)) AS e FROM events GROUP BY user_id)",
    "sample_failures": f"""
        WITH l AS (SELECT l_orderkey, row_number() OVER w - 1 AS i, l_returnflag = 'R' AS bad, l_discount > {_D.format(0.07)} AS cut,
                          CASE WHEN l_tax > {_D.format(0.04)} THEN 'solver_error: ' || CAST(l_linenumber AS VARCHAR) ELSE 'judge down' END AS f
                   FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
        SELECT l_orderkey, arg_min(f, i) FILTER (bad) AS first_error, coalesce(string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (bad AND f LIKE 'solver_error%'), '') AS again,
               CASE WHEN count(*) FILTER (cut) > 0 THEN '; ' || CAST(count(*) FILTER (cut) AS VARCHAR) || '/' || CAST(count(*) AS VARCHAR) || ' weak attempts hit the token budget' ELSE '' END AS note
        FROM l GROUP BY l_orderkey""",
    "jsonl_round_trip": "SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations",
    "runs_union": "SELECT CAST(1 - doc_id % 2 AS INTEGER) AS run_ord, source AS paper_id, count(*) AS n FROM documents GROUP BY 1, 2",
    "usage_logs": f"""
        SELECT event_type AS role, count(*) AS calls, count(*) FILTER ({_K} = 0) AS usage_missing, round(sum(value), 3) AS latency_s, CAST(sum({_K}) AS BIGINT) AS prompt_tokens,
               CAST(sum({_K} * 2) AS BIGINT) AS completion_tokens, CAST(sum(CASE WHEN {_K} % 2 = 0 THEN {_K} ELSE 0 END) AS BIGINT) AS reasoning_tokens, CAST(0 AS BIGINT) AS cached_tokens FROM events GROUP BY 1""",
    "prompt_render": "SELECT p_partkey, p_name || ': $' || CAST(p_size AS VARCHAR) || ', ' || p_brand || '/' || p_name || '; $other $' AS prompt FROM part",
    "challenger_messages": f"""
        SELECT n_nationkey, n_name || {_NL} || CAST(n_nationkey AS VARCHAR) || {_NL} || 'text' || {_NL} || CASE WHEN n_nationkey % 2 = 1
                   THEN 'failed: $task ' || n_name || {_NL} || 'Write an entirely new question from another side, as JSON.' ELSE 'Write a question and a rubric as JSON.' END AS message FROM nation""",
    "rubric_json": """
        WITH l AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * (l_partkey % 10 + 1) AS w FROM lineitem)
        SELECT l_orderkey, '[' || string_agg('{"criterion": "c' || CAST(l_partkey AS VARCHAR) || '", "weight": ' || CAST(w AS VARCHAR) || ', "category": "' || CASE WHEN w > 0 THEN 'positive' ELSE 'negative' END || '"}',
                                             ', ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_discount) || ']' AS rubric FROM l GROUP BY l_orderkey""",
    "criterion_matrix": f"""
        WITH l AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_discount))
        SELECT l_orderkey, CAST(k AS INTEGER) AS k, 'c' || CAST(l_partkey AS VARCHAR) AS criterion, CAST(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * (l_partkey % 10 + 1) AS INTEGER) AS weight,
               round({_SCORES}, 6) AS first, CASE WHEN k < n - 1 THEN round({_SCORES}, 6) END AS second FROM l""",
    "reply_verdicts": """
        SELECT doc_id, CASE WHEN doc_id % 7 > 0 THEN toxic = 0 AND quality = 1 END AS passed,
               CASE WHEN doc_id % 7 > 0 THEN concat_ws(',', CASE WHEN toxic <> 0 THEN 'check_1_verdict=LEAKAGE' END, CASE WHEN quality <> 1 THEN 'check_2_verdict=MISSING' END) END AS issues,
               CASE WHEN doc_id % 7 > 0 THEN 'id ' || CAST(doc_id AS VARCHAR) || chr(10) || 'Rubric issues: thin' END AS feedback FROM labels""",
    "round_outcomes": """
        SELECT event_id, CASE WHEN event_id % 31 = 0 THEN 'paper_too_long' WHEN event_id % 13 = 0 THEN 'malformed' WHEN event_id % 17 = 0 THEN 'error' WHEN event_id % 19 = 0 THEN 'infra_error'
                              WHEN event_id % 7 = 0 THEN 'failed_qv' WHEN event_id % 11 = 0 THEN 'infra_error' WHEN event_id % 2 = 0 THEN 'too_easy' WHEN event_id % 5 = 0 THEN 'infra_error'
                              WHEN event_id % 3 = 0 THEN 'accepted' ELSE 'failed_on_strong' END AS outcome FROM events""",
    "minibatch_papers": "SELECT doc_id FROM documents ORDER BY md5(concat('7:', CAST(doc_id AS VARCHAR))), doc_id LIMIT 20",
    "variant_ancestry": """
        WITH RECURSIVE v AS (SELECT CAST(n_nationkey AS BIGINT) AS variant_id, CAST(n_nationkey // 2 AS BIGINT) AS parent_id FROM nation WHERE n_nationkey > 0),
        a AS (SELECT variant_id, parent_id AS ancestor_id, 1 AS depth FROM v UNION ALL SELECT a.variant_id, v.parent_id, depth + 1 FROM a JOIN v ON a.ancestor_id = v.variant_id)
        SELECT variant_id, ancestor_id, depth FROM a""",
    "child_acceptance": "SELECT o_custkey, max(p) > sum(p) / count(*) AS accepted FROM (SELECT o_custkey, round(o_totalprice) AS p FROM orders) GROUP BY o_custkey",
    "chat_prompt_table": "SELECT 'q' || CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS VARCHAR) AS qa_id, p_partkey, 'system=be brief|user=about ' || p_name AS prompt FROM part",
    "chat_answers": f"SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN '' ELSE {_STRIP.format('text')} END AS answer FROM conversations",
    "paper_titles": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) ELSE source END AS title FROM documents",
    "earlier_questions": """
        SELECT conv_id, turn, coalesce(string_agg(role, ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS earlier FROM conversations""",
    "papers_on_disk": f"SELECT doc_id, CAST(length(t) AS INTEGER) AS chars FROM (SELECT doc_id, {_STRIP.format('text')} AS t FROM documents) WHERE t <> ''",
    "session_texts": """
        WITH e AS (SELECT user_id, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
        r AS (SELECT user_id, string_agg(CASE WHEN t = 'error' THEN '--- Round ' || CAST(i AS VARCHAR) || ' | stopped by infrastructure (left out) ---'
                                              ELSE '--- Round ' || CAST(i AS VARCHAR) || ' | malformed ---' || chr(10) || t END, chr(10) ORDER BY i) AS b FROM e GROUP BY user_id)
        SELECT CAST(user_id AS VARCHAR) AS session_id, 'paper ' || CAST(user_id AS VARCHAR) || ' "T" | ' || CASE WHEN user_id % 2 = 0 THEN 'PASSED' WHEN user_id % 3 = 0 THEN 'STOPPED (crash, left out)' ELSE 'FAILED' END
               || ' ===' || chr(10) || b AS digest FROM r""",
    "extract_json": "SELECT conv_id, turn, turn AS found_turn, 2 AS n_tags FROM conversations",
}

QUERIES = {
    f.__name__: f
    for f in (
        rubric_score, rubric_score_arrays, outcome_counts, gate_reasons, mean_best_at_k, plain_averages, usage_by_role, session_score, stopped_sessions, dedupe_questions,
        split_by_paper, split_train_val, split_manifest, length_window_sha, snippet_300, clip_answer, blank_questions, verdict_gate, rubric_shape_issues, criterion_checks,
        history_text, failure_history, html_title, listing_ids, boltzmann_weights, first_tie_argmax, best_variant, sample_replication, running_parent_mean, accepted_children,
        papers_without_verdict, papers_with_verdict, reward_lookup, last_30_log, run_summary, judge_normalise, answer_text, error_taxonomy, html_to_markdown, extract_json,
        stop_outcomes, sample_failures, jsonl_round_trip, runs_union, usage_logs, prompt_render, challenger_messages, rubric_json, criterion_matrix, reply_verdicts, round_outcomes, minibatch_papers,
        variant_ancestry, child_acceptance, chat_prompt_table, chat_answers, paper_titles, earlier_questions, papers_on_disk, session_texts, inner_loop_scripted,
    )
}
