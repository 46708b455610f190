import json

import pytest
from pyspark.sql import functions as F

from quillforge.functions import html, json_text, text
from quillforge.operators import dataset, history, metrics, sampling
from quillforge.plans import config, outer_loop, prompts
from quillforge.sources import listing, readers, schemas, sinks
from quillforge.streaming import usage


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_white_space_is_pythons(spark):
    raw = "\x1c a \x85b  c　\n"
    assert value(spark, text.collapse(F.lit(raw))) == " ".join(raw.split())
    assert value(spark, text.strip(F.lit(raw))) == raw.strip()
    assert value(spark, text.is_blank(F.lit("\x1f  "))) and value(spark, text.is_blank(F.lit(None).cast("string")))


def test_snippet_and_clip(spark):
    assert value(spark, text.snippet(F.lit("a  b"))) == "a b"
    long = value(spark, text.snippet(F.lit("x" * 400)))
    assert len(long) == 300 and long.endswith("...")
    assert value(spark, text.clip(F.lit(" abcdef "), 4)) == "abcd [... 2 more chars]"


@pytest.mark.parametrize(
    ("completion", "thinking", "want"),
    [("<think>a</think> b ", False, "b"), ("a</think>b</think> c", True, "c"), ("<think>a", False, ""), ("x <think>a", False, ""), ("plain ", False, "plain"), ("plain", True, "")],
)
def test_answer_text(spark, completion, thinking, want):
    assert value(spark, text.answer_text(F.lit(completion), thinking)) == want


def test_split_thinking_only_looks_at_the_start(spark):
    got = value(spark, text.split_thinking(F.lit("see <think> tags")))
    assert (got.answer, got.finished) == ("see <think> tags", True)
    assert not value(spark, text.split_thinking(F.lit("x"), True)).finished


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('{"a": 1}', {"a": 1}), ('here:\n```json\n{"x": [1, 2]}\n```\nend', {"x": [1, 2]}), ('{"a": 1, "b": [2, 3,], }', {"a": 1, "b": [2, 3]}), ("[1, 2, 3]", [1, 2, 3]),
        ('noise { left open: {"x": 1}', {"x": 1}), ('{ "x": 1 ] then {"y": 2}', {"y": 2}), ('{"q": "a { in it"}', {"q": "a { in it"}), ('{so} ```json\n{"answer": 42}\n```', {"answer": 42}),
        ("nothing", None),
    ],
)
def test_extract_json(spark, reply, want):
    got = value(spark, json_text.extract_json(F.lit(reply)))
    assert (None if got is None else json.loads(got)) == want


def test_template_values_are_not_looked_at_again(spark):
    assert value(spark, json_text.fill_template("$a/$b/$c", ["a", "b"], F.lit("$b"), F.lit("2"))) == "$b/2/$c"


def test_titles_and_ids(spark):
    assert value(spark, text.markdown_title(F.lit("# \nx\n  # My Title  \n# other"), F.lit("stem"))) == "My Title"
    assert value(spark, text.markdown_title(F.lit("## no"), F.lit("stem"))) == "stem"
    assert value(spark, text.file_id(text.listing_id(F.lit("http://h/abs/cs/01v2")))) == "cs_01"


PAGE = """<article class="ltx_document"><h1 class="ltx_title ltx_title_document">T</h1><div class="ltx_authors">Jane</div><h2>1 Method</h2>
<p>rank_r <math alttext="r_{t}" display="inline"><mi>r</mi></math> see <cite>[<a href="#b">1</a>]</cite></p>
<table class="ltx_equation"><tr><td><math alttext="y=x" display="block"><mi>y</mi></math></td><td>(1)</td></tr></table>
<table><tr><td>Model</td><td>Acc</td></tr><tr><td>Ours</td><td>91.2</td></tr></table><section class="ltx_bibliography">Prior</section></article>"""


def test_html_to_markdown():
    md = html.to_markdown(PAGE, " A Title ")
    assert md.startswith("# A Title\n") and md.count("\n# ") == 0
    for there in ("## 1 Method", "rank_r $r_{t}$ see [1]", "$$y=x$$", "| Ours | 91.2 |"):
        assert there in md
    for gone in ("Jane", "Prior", "#b", "(1)", "\n\n\n"):
        assert gone not in md
    assert html.to_markdown("<p>no article</p>", "t") is None and html.to_markdown(None, "t") is None


def test_papers(spark, tmp_path):
    (tmp_path / "b.md").write_text("# Beta\ntext")
    (tmp_path / "a.md").write_text(" \n\x1c")
    (tmp_path / "c.md").write_bytes(b"\xff\xfe")
    (tmp_path / "d.md").write_text("no title")
    got = [(r.paper_id, r.title) for r in readers.read_papers(spark, str(tmp_path), 2).collect()]
    assert got == [("b", "Beta"), ("d", "d")]
    with pytest.raises(Exception, match="(?i)path"):
        readers.read_papers(spark, str(tmp_path / "none")).collect()


def test_jsonl_runs_and_manifest(spark, tmp_path):
    rows = [{"question": q, "paper_id": p} for q, p in (("Same  question?", "p1"), ("same question?", "p2"), ("other?", "p2"))]
    for i, part in enumerate((rows[:1], rows[1:])):
        (tmp_path / f"r{i}").mkdir()
        (tmp_path / f"r{i}" / "final_qa.jsonl").write_text("\n".join(map(json.dumps, part)) + "\n\n")
    runs = readers.read_runs(spark, [str(tmp_path / "r0"), str(tmp_path / "r1")])
    kept = dataset.first_wins(runs, "question", ["run_ord", "line_ord"])
    assert sorted((r.question, r.paper_id) for r in kept.collect()) == [("Same  question?", "p1"), ("other?", "p2")]
    with pytest.raises(Exception, match="(?i)path"):
        readers.read_runs(spark, [str(tmp_path / "r0"), str(tmp_path / "r9")]).collect()
    assert sinks.write_jsonl(kept.drop("metadata"), str(tmp_path / "out"), single=True) == 2
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl"), schemas.PAPER).collect()


def test_split_is_disjoint_and_overshoots(spark):
    rows = spark.createDataFrame([(f"p{i // 2}", i) for i in range(40)], "paper string, q int")
    split = dataset.split_by_paper(rows, "paper", 5).collect()
    test = {r.paper for r in split if r.split == "test"}
    assert sum(r.split == "test" for r in split) == 6 and not test & {r.paper for r in split if r.split == "train"}
    with pytest.raises(ValueError):
        dataset.split_by_paper(rows, "paper", 40)
    with pytest.raises(ValueError):
        dataset.split_papers(rows.select("paper").distinct(), "paper", 20, 1)
    m = dataset.manifest(dataset.split_by_paper(rows, "paper", 5), "paper", 42).first()
    assert (m.n_test, m.n_train, m.test_papers) == (6, 34, sorted(test))


def test_must_match(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, "a")], "id int, x string")
    with pytest.raises(Exception, match="unknown id: 2"):
        dataset.must_match(left, right, "id").collect()


def test_at_k(spark):
    samples = [("a", s, False, False) for s in (0.2, 0.4, 0.6)] + [("b", s, False, s == 1) for s in (0.0, 1.0, 0.5)] + [("c", 0.9, True, True)]
    df = spark.createDataFrame(samples, "q string, s double, infra boolean, cut boolean")
    r = metrics.at_k(df, "q", "s", "infra", "cut").first()
    assert (r.n, r.left_out, round(r.mean_at_k, 9), round(r.best_at_k, 9), round(r.truncation_rate, 9)) == (2, 1, 0.45, 0.8, round(1 / 6, 9))
    none = metrics.at_k(df.where("infra"), "q", "s", "infra", "cut").first()
    assert (none.n, none.mean_at_k, none.truncation_rate) == (0, None, None)


def test_session_scores(spark):
    df = spark.createDataFrame([(1, True, None), (1, False, None), (1, False, "infra_error"), (2, False, "crash")], "g int, passed boolean, stopped_by string")
    scores = {r.g: r for r in metrics.session_scores(df, "g", F.col("passed"), F.col("stopped_by").isNull()).collect()}
    assert scores[1].score == 0.5 and not scores[1].valid and scores[2].score is None and not scores[2].valid
    assert {r.g: r.valid for r in metrics.session_scores(df, "g", F.col("passed"), F.col("stopped_by").isNull(), 0.6).collect()} == {1: True, 2: False}


def test_usage_of_several_logs_is_that_of_one(spark, tmp_path):
    log = [{"role": "judge", "model": f"m{i}", "prompt_tokens": i or None, "usage_missing": not i, "latency_s": 0.5, "finish_reason": "stop"} for i in range(4)]
    for i in range(2):
        (tmp_path / f"u{i}.jsonl").write_text("\n".join(map(json.dumps, log[2 * i : 2 * i + 2])))
    both = readers.read_usage(spark, [str(tmp_path / f"u{i}.jsonl") for i in range(2)]).withColumn("seq", F.col("model"))
    r = metrics.usage_totals(both, "seq").first()
    assert (r.role, r.model, r.calls, r.usage_missing, r.prompt_tokens, r.latency_s) == ("judge", "m0", 4, 1, 6, 2.0)
    query = usage.usage_stream(spark, str(tmp_path)).writeStream.format("memory").queryName("usage").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert [(r.role, r.calls, r.prompt_tokens) for r in spark.table("usage").collect()] == [("judge", 4, 6)]


def test_history_groups_by_mode(spark):
    rows = [("p", "weak_zero", 0, "Q0", "d0"), ("p", "too_easy", 2, "Q2", "d2"), ("p", "too_easy", 1, "Q1", "d1")]
    got = history.render_history(spark.createDataFrame(rows, "paper_id string, mode string, seq int, question string, detail string")).first().history
    assert got.index("TOO EASY") < got.index("- Q: Q1\n  d1\n- Q: Q2\n  d2") < got.index("WEAK SCORED ZERO") < got.index("- Q: Q0")


def test_sampling(spark):
    import random

    v = spark.createDataFrame([("a", 0.1), ("b", 0.9), ("c", None), ("d", 0.9)], "k string, s double")
    p = {r.k: r.p for r in sampling.boltzmann(v, "k", "s", 0.1).collect()}
    assert sum(p.values()) == pytest.approx(1) and p["b"] == p["d"] > p["a"] > p["c"]
    assert {sampling.draw(v, "k", "s", 0, random.Random(i)) for i in range(8)} == {"b", "d"}
    assert sampling.best_variant(v, "s", "k").first().k == "b"
    with pytest.raises(ValueError):
        sampling.draw(v.where("false"), "k", "s", 0, random.Random(1))
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "variant_id string, parent_id string")
    assert sorted((r.variant_id, r.ancestor_id, r.depth) for r in sampling.ancestry(tree).collect()) == [("b", "a", 1), ("c", "a", 2), ("c", "b", 1)]


def seed_prompts():
    return prompts.PromptSet({name: " ".join(["words", *[f"${s}" for s in needed]]) for name, (needed, _) in prompts.FIELDS.items()}, {"qv_system": ("words",)})


def test_prompts(tmp_path):
    seed = seed_prompts()
    for name, t in seed.texts.items():
        (tmp_path / f"{name}.txt").write_text(t + "\n\n")
    assert prompts.PromptSet.load(tmp_path).texts == seed.texts and seed.problems() == []
    made, changed = seed.edited("why\n<<<challenger_system>>>\nbetter\n<<<end>>>\n")
    assert changed == ["challenger_system"] and made.texts["challenger_system"] == "better"
    for reply in ("nothing", "<<<qv_system>>>\nx\n<<<end>>>", "<<<challenger_retry>>>\nno slot\n<<<end>>>", "<<<challenger_system>>>\n$foo\n<<<end>>>"):
        with pytest.raises(ValueError):
            seed.edited(reply)
    with pytest.raises(ValueError):
        seed.edited("<<<challenger_system>>>\n" + "x" * 30_000 + "\n<<<end>>>")


def test_config():
    s = config.from_dict({"roles": {"judge": {"model": "m"}}, "acceptance": {"gap_min": 0.1}})
    assert s.roles["judge"].max_tokens == 2000 and s.acceptance.gap_min == 0.1 and s.acceptance.weak_avg_max == 0.65
    assert config.BatchShape().accumulation() == 32
    for bad in ({"meta": {"iterations": 1}}, {"nope": 1}, {"roles": {"j": {"model": "m", "thinking": True, "reasoning_effort": "none"}}}):
        with pytest.raises(ValueError):
            config.from_dict(bad)


def test_outer_loop(spark):
    papers = spark.createDataFrame([(f"p{i}",) for i in range(12)], "paper_id string")

    def run(p, sessions):
        good = "better" in p.texts["challenger_system"]
        return sessions.select("paper_id", "sample", F.lit(good).alias("passed"), F.lit(None).cast("string").alias("stopped_by"))

    edits = iter(["<<<challenger_system>>>\nbetter\n<<<end>>>", "junk", "junk", "junk", "<<<challenger_first>>>\nmore\n<<<end>>>"])
    meta = config.Meta(iterations=3, n_train=6, n_val=4, minibatch=2, samples_per_paper=1, temperature=0.0)
    population = outer_loop.run_outer_loop(papers, seed_prompts(), run, lambda p, s: "study", lambda p, a, problem: next(edits), meta)
    assert [e["status"] for e in population.log] == ["accepted", "no_proposal", "rejected"]
    assert outer_loop.best(population).variant_id == "v1" and outer_loop.render_log(population.log).count("\n") == 2


def test_listing_entries():
    xml = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://h/abs/1.2v3</id><title> A\n  title</title></entry></feed>'
    assert listing.entries(xml) == [("1.2v3", "A title")]


def test_corpus(spark):
    listed = spark.createDataFrame([(i, f"1.{i}v1", f"t{i}") for i in range(5)], "ord int, listing_id string, title string")
    page = lambda n: '<article class="ltx_document"><p>' + "w " * n + "</p></article>"
    pages = spark.createDataFrame([("1.0v1", page(50)), ("1.1v1", page(50)), ("1.2v1", "<p>none</p>"), ("1.3v1", page(50)), ("1.4v1", page(5))], "listing_id string, html string")
    got = listing.build_corpus(listed, pages, spark.createDataFrame([("1.0",)], "paper_id string"), 5, 5, shortest=60, longest=1000).collect()
    assert sorted(r.paper_id for r in got) == ["1.1", "1.3"] and all(len(r.sha12) == 12 for r in got)


def test_export(tmp_path):
    (tmp_path / "base").mkdir()
    (tmp_path / "out").mkdir()
    for name in ("a.json", "model.safetensors", "tok.txt"):
        (tmp_path / "base" / name).write_text("x")
    (tmp_path / "out" / "a.json").write_text("mine")
    assert sinks.complete_export(tmp_path / "out", tmp_path / "base") == ["tok.txt"] and (tmp_path / "out" / "a.json").read_text() == "mine"
