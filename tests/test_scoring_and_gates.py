import pytest
from pyspark.sql import functions as F

from quillforge.functions import gates, scoring, verdict


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def doubles(xs):
    return F.array(*[F.lit(float(x)) for x in xs]) if xs else F.expr("cast(array() as array<double>)")


def ints(xs):
    return F.array(*[F.lit(x) for x in xs])


@pytest.mark.parametrize(
    ("scores", "weights", "want"),
    [([1, 0.5, 0], [4, 2, 2], 0.625), ([1, 1, 0], [5, 3, -4], 1.0), ([1, 1, 1], [5, 3, -4], 0.5), ([1, 0, 0.5], [5, 3, -4], 0.375), ([0, 0, 1], [5, 3, -4], 0.0), ([1, 1], [-1, -2], 0.0)],
)
def test_rubric_score(spark, scores, weights, want):
    assert one(spark, s=scoring.rubric_score(doubles(scores), ints(weights))).s == pytest.approx(want)


def test_rubric_score_needs_equal_lengths(spark):
    with pytest.raises(Exception, match="as many scores"):
        one(spark, s=scoring.rubric_score(doubles([1]), ints([1, 2])))


@pytest.mark.parametrize(
    ("reply", "n", "want"),
    [
        ('{"per_criterion": [1.1, 0.5, 1.05]}', 3, [1, 0.5, 1]), ('{"per_criterion": [-0.1, 0, 0.5]}', 3, [0, 0, 0.5]), ('{"per_criterion": [1, "0.5", true]}', 3, [1, 0.5, 1]),
        ('{"per_criterion": [1, null, 1]}', 3, None), ('{"per_criterion": [1, 1]}', 3, None), ('{"per_criterion": [2, 1, 1]}', 3, None), ('{"per_criterion": ["x", 1, 1]}', 3, None),
        ('{"per_criterion": 1}', 1, None), ("no json", 1, None), (None, 1, None),
    ],
)
def test_usable_scores(spark, reply, n, want):
    assert one(spark, s=scoring.usable_scores(F.lit(reply).cast("string"), n)).s == want


def weak(spark, scores, **t):
    s = doubles(scores)
    return one(spark, c=gates.weak_check(gates.mean(s), F.array_max(s), F.size(F.filter(s, lambda x: x == 0)), gates.Thresholds(**t))).c


def test_weak_check(spark):
    assert weak(spark, [0.3, 0.4, 0.5]).passed
    assert weak(spark, [0.7, 0.7]).too_easy and weak(spark, [0.5, 0.8]).too_easy
    zero = weak(spark, [0.0, 0.4, 0.4])
    assert zero.has_zero and not zero.passed and not zero.too_easy
    assert weak(spark, [0.0, 0.4, 0.4], no_zeros=False).passed
    assert not weak(spark, []).passed


@pytest.mark.parametrize(
    ("weak_avg", "strong", "reasons"),
    [(0.30, [0.8, 0.8], []), (0.40, [0.97, 0.96], ["saturated"]), (0.30, [0.5, 0.55], ["strong_avg_low"]), (0.55, [0.65, 0.65], ["gap"]), (0.9, [0.5], ["strong_avg_low", "gap"])],
)
def test_strong_check(spark, weak_avg, strong, reasons):
    got = one(spark, c=gates.strong_check(F.lit(weak_avg), gates.mean(doubles(strong)))).c
    assert got.reasons == reasons and got.passed == (not reasons)


def test_outcome_order_and_stop(spark):
    args = [F.lit(0.9), F.lit(0.9), F.lit(1), F.lit(None).cast("double")]
    assert one(spark, o=gates.gate_outcome(*args)).o == "too_easy"
    outcomes = F.array(F.lit("too_easy"), F.lit("infra_error"))
    assert one(spark, o=gates.stops(outcomes)).o == "infra_error"
    assert one(spark, o=gates.stops(F.array(F.lit("infra_error"), F.lit("accepted")))).o is None
    assert one(spark, o=gates.stops(F.expr("cast(array() as array<string>)"))).o is None


def test_samples(spark):
    rows = [(0.2, "solver_error: x", True, False), (0.5, "PARSE_FAIL", True, True), (0.5, "b", False, True)]
    df = spark.createDataFrame([(rows,)], "s array<struct<weighted_score:double,judge_feedback:string,infra_error:boolean,truncated:boolean>>")
    r = df.select(
        gates.first_infra_error(F.col("s")).alias("e"), gates.to_rerun(F.col("s")).alias("again"), gates.truncation_note(F.col("s"), "weak").alias("note"),
        gates.first_best(F.col("s"))["judge_feedback"].alias("best"), gates.first_best(F.col("s"), ascending=True)["judge_feedback"].alias("worst"),
    ).first()
    assert (r.e, r.again, r.note, r.best, r.worst) == ("solver_error: x", [0], "; 2/3 weak attempts hit the token budget", "PARSE_FAIL", "solver_error: x")


GOOD = '{"check_1_verdict": "%s", "check_2_verdict": " good ", "check_3_verdict": "PASS", "check_4_verdict": "CONSISTENT", "overall": %s, "feedback": "ok"%s}'


@pytest.mark.parametrize(
    ("reply", "passed", "issues"),
    [
        (GOOD % ("NO_LEAKAGE", '"PASS"', ""), True, []), (GOOD % ("no_leakage", '" pass "', ""), True, []), (GOOD % ("LEAKAGE", '"PASS"', ""), False, ["check_1_verdict=LEAKAGE"]),
        (GOOD % ("NO_LEAKAGE", '"FAIL"', ""), False, ["overall=FAIL"]), (GOOD % ("NO_LEAKAGE", "true", ""), False, ["overall=MISSING"]), (GOOD % ("NO_LEAKAGE", "null", ""), False, ["overall=MISSING"]),
        ("{}", False, ["check_1_verdict=MISSING", "check_2_verdict=MISSING", "check_3_verdict=MISSING", "check_4_verdict=MISSING"]),
    ],
)
def test_verdict_fails_closed(spark, reply, passed, issues):
    v = one(spark, v=verdict.verdict(F.lit(reply))).v
    assert (v.passed, v.issues) == (passed, issues)


def test_verdict_feedback_and_shape(spark):
    v = one(spark, v=verdict.verdict(F.lit(GOOD % ("NO_LEAKAGE", '"PASS"', ', "check_3_issues": ["a", "b"], "check_3_counts": "7/3"')))).v
    assert v.feedback == "ok\nRubric issues: a; b" and v.checks["check_3_counts"] == "7/3"
    assert one(spark, v=verdict.verdict(F.lit("[1]"))).v is None
    shape = lambda p, n: one(spark, s=verdict.rubric_shape(F.lit(p), F.lit(n))).s
    assert shape(7, 10) == [] and shape(15, 21) == ["total"] and shape(8, 10) == ["negative"] and shape(3, 10) == ["positive"] and shape(6, 9) == ["total"]


@pytest.mark.parametrize(
    ("criterion", "weight", "category", "ok"),
    [("abc", 10, "positive", True), ("abc", -10, "negative", True), ("ab ", 1, "positive", True), ("ab", 1, "positive", False), ("abc", 0, "positive", False), ("abc", 11, "positive", False), ("abc", -1, "positive", False), ("abc", 1, "negative", False), (None, 1, "positive", False)],
)
def test_criterion(spark, criterion, weight, category, ok):
    c = F.array(F.struct(F.lit(criterion).cast("string").alias("criterion"), F.lit(weight).alias("weight"), F.lit(category).alias("category")))
    assert one(spark, v=verdict.rubric_valid(c)).v is ok
