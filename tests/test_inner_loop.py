"""The loop with scripted models: refinement, short-circuits, error taxonomy."""

import json

from pyspark.sql import functions as F

from quillforge.operators import calls
from quillforge.plans import inner_loop

RUBRIC = [{"criterion": f"point {i}", "weight": w, "category": "positive" if w > 0 else "negative"} for i, w in enumerate((3, 3, 3, 3, 2, 2, 2, -3, -2, -2))]
VERDICT = {"check_1_verdict": "NO_LEAKAGE", "check_2_verdict": "GOOD", "check_3_verdict": "PASS", "check_4_verdict": "CONSISTENT", "overall": "PASS", "feedback": "ok"}


def question(q):
    return json.dumps({"question_type": "t", "skill_tags": ["s"], "context": "ctx", "question": q, "reference_answer": "SECRET", "rubric": RUBRIC})


def scripted(role, system, user, attempt):
    if role == "challenger":
        if "too long" in user:
            raise calls.ModelError("context_length", "maximum context length")
        if "broken key" in user:
            raise calls.ModelError("auth", "401")
        if "Q-hard" in user:
            return question("Q-good")
        if "Q-easy" in user:
            return question("Q-hard")
        if "Q-leaky" in user:
            return question("Q-easy")
        if "malformed" in user or "paper Z" not in user:
            return question("Q-leaky")
        return "no JSON"
    assert "SECRET" not in user
    if role == "quality_verifier":
        return json.dumps({**VERDICT, "check_1_verdict": "LEAKAGE"} if "Q-leaky" in user else VERDICT)
    if role == "judge":
        weak = "weak says" in user
        full = [1] * 7 + [0] * 3
        if "Q-easy" in user:
            return json.dumps({"per_criterion": full if weak else [1] * 10})
        if weak or "Q-hard" in user:
            return json.dumps({"per_criterion": [0.5] * 7 + [0] * 3, "feedback": "half"})
        return json.dumps({"per_criterion": [1] * 6 + [0] * 4, "feedback": "most"})
    return "weak says" if role == "weak_solver" else "strong says"


def run(spark, papers, function=scripted, **cfg):
    df = spark.createDataFrame(papers, "paper_id string, title string, text string")
    rows = inner_loop.run_inner_loop(df, calls.FunctionModels(function), inner_loop.LoopConfig(samples=2, max_iterations=6, **cfg))
    return {p: [(r.outcome, r.accepted) for r in sorted(rows.where(F.col("paper_id") == p).collect(), key=lambda r: r.iteration)] for p, _, _ in papers}, rows


def test_refinement_until_accepted_and_stops(spark):
    got, rows = run(spark, [("a", "A", "text"), ("z", "paper Z", "text"), ("l", "L", "too long"), ("k", "K", "broken key")])
    path = ["failed_qv", "too_easy", "failed_on_strong", "accepted"]
    assert [o for o, _ in got["a"]] == path and got["a"][-1][1]
    assert [o for o, _ in got["z"]] == ["malformed", *path]
    assert got["l"] == [("paper_too_long", False)] and got["k"] == [("error", False)]
    last = rows.where("paper_id = 'a' and accepted").first()
    assert round(last.weak_avg, 3) == 0.5 and round(last.strong_avg, 3) == 0.889 and round(last.gap, 3) == 0.389
    done = rows.where("accepted")
    papers = spark.createDataFrame([("a", "A", "text"), ("z", "paper Z", "text")], "paper_id string, title string, text string")
    assert {(r.paper_id, r.passed) for r in inner_loop.final_filter(done, papers, calls.FunctionModels(scripted)).collect()} == {("a", True), ("z", True)}


def flaky(role, system, user, attempt):
    if role == "challenger":
        return question("Q-good")
    if role == "weak_solver":
        return "" if attempt < 1000 else "weak says"
    if role == "judge" and "weak" in user:
        return "garbage"
    return scripted(role, system, user, attempt)


def test_technical_failures_stop_without_history(spark):
    got, rows = run(spark, [("a", "A", "text")], flaky, infra_retries=1)
    assert got["a"] == [("infra_error", False)] and rows.first().error == "PARSE_FAIL"


def cut_off(role, system, user, attempt):
    if role == "weak_solver":
        return calls.Reply("", truncated=True)
    return question("Q-good") if role == "challenger" else scripted(role, system, user, attempt)


def test_cut_off_answers_score_zero(spark):
    got, _ = run(spark, [("a", "A", "text")], cut_off)
    assert got["a"] == [("weak_zero", False)] * 6


def test_only_transient_errors_are_tried_again():
    class Backend:
        def __init__(self, kind, fails):
            self.kind, self.left, self.calls = kind, fails, 0

        def reply(self, *args):
            self.calls += 1
            if self.left:
                self.left -= 1
                raise calls.ModelError(self.kind, "x")
            return calls.Reply("ok", prompt_tokens=3)

    waits = []
    good = Backend("transient", 2)
    assert calls.call_once(good, "r", "s", "u", 0, waits.append)["text"] == "ok" and waits == [2.0, 4.0]
    bad = Backend("auth", 1)
    assert calls.call_once(bad, "r", "s", "u", 0, waits.append)["error_class"] == "auth" and bad.calls == 1
    down = Backend("transient", 9)
    assert calls.call_once(down, "r", "s", "u", 0, waits.append)["error_class"] == "transient" and down.calls == 4


def test_rewards(spark):
    from quillforge.operators import rewards

    criteria = "array<struct<criterion:string,weight:int,category:string>>"
    qas = spark.createDataFrame([("q0", "ctx", "Q?", [(c["criterion"], c["weight"], c["category"]) for c in RUBRIC])], f"qa_id string, context string, question string, criteria {criteria}")
    rows = [(1, "q0", "<think>x</think> good"), (2, "q0", "<think>never ends"), (3, "q0", "<think></think> odd")]
    done = spark.createDataFrame(rows, "completion_id int, qa_id string, completion string")

    def judge(role, system, user, attempt):
        assert "never ends" not in user
        return "garbage" if "odd" in user else json.dumps({"per_criterion": [1] * 7 + [0] * 3})

    got = {r.completion_id: r.reward for r in rewards.rewards(done, qas, calls.FunctionModels(judge), True).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: None}
    prompts = rewards.chat_prompts(qas.drop("qa_id"), "sys", F.col("question"), ["question"]).first()
    assert prompts.qa_id == "q0" and [m.role for m in prompts.prompt] == ["system", "user"]


def test_digest(spark):
    from quillforge.operators import digest

    rows = [("p", 0, "Q?", "too_easy", 0.7, None, ["weak_avg"]), ("p", 1, None, "error", None, None, None)]
    df = spark.createDataFrame(rows, "paper_id string, iteration int, question string, outcome string, wa double, sa double, reasons array<string>")
    rendered = digest.render_round(F.col("question"), F.col("outcome"), F.col("wa"), F.col("sa"), F.col("reasons"))
    got = digest.render_sessions(df, ["paper_id"], "iteration", rendered).first().digest
    assert got == "## round 0\noutcome: too_easy  weak_avg=0.70  strong_avg=-\nreasons: weak_avg\nquestion: Q?\n\n## round 1\noutcome: error"
    nested = spark.createDataFrame([("p", [("a", 1), ("b", 2)], [([0.1, 0.2],), ([0.3],)])], "paper_id string, c array<struct<criterion:string,weight:int>>, s array<struct<per_criterion:array<double>>>")
    assert [(r.criterion, r.scores) for r in digest.criterion_scores(nested, "c", "s", ["paper_id"]).orderBy("k").collect()] == [("a", [0.1, 0.3]), ("b", [0.2, None])]


def test_http_requests():
    from quillforge.plans.config import Role
    from quillforge.sources import http_models

    models = http_models.HttpModels("http://x", {"judge": Role("m", thinking=True), "weak_solver": Role("n", reasoning_effort="none")}, extra={"judge": {"top_k": 20}})
    body = models.request("judge", "s", "u")
    assert body["chat_template_kwargs"] == {"enable_thinking": True} and body["top_k"] == 20 and [m["content"] for m in body["messages"]] == ["s", "u"]
    assert models.request("weak_solver", "s", "u")["reasoning_effort"] == "none"
    kinds = [http_models.classify(400, "maximum context length"), http_models.classify(401, ""), http_models.classify(503, ""), http_models.classify(404, "")]
    assert kinds == ["context_length", "auth", "transient", "other"]
