"""Verifier verdicts that fail closed, and checks of rubrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: What each check must say for a package to pass.
PASSING = {"check_1_verdict": "NO_LEAKAGE", "check_2_verdict": "GOOD", "check_3_verdict": "PASS", "check_4_verdict": "CONSISTENT"}


def token(value: Column) -> Column:
    """Upper case without white space around; anything that isn't a string is empty."""
    return F.upper(strip(F.coalesce(value, F.lit(""))))


def judge_tokens(tokens: dict[str, Column], overall: Column) -> Column:
    """struct(passed, issues, checks) from the checks' tokens and the overall one.

    ``overall`` is only an issue where no check failed.
    """
    said = lambda name, value: F.concat(F.lit(f"{name}="), F.when(value == "", "MISSING").otherwise(value))
    issues = F.array_compact(F.array(*[F.when(tokens[k] != want, said(k, tokens[k])) for k, want in PASSING.items()]))
    issues = F.when((F.size(issues) == 0) & (overall != "PASS"), F.array(said("overall", overall))).otherwise(issues)
    checks = F.map_from_arrays(F.array(*[F.lit(k) for k in PASSING]), F.array(*[tokens[k] for k in PASSING]))
    return F.struct((F.size(issues) == 0).alias("passed"), issues.alias("issues"), checks.alias("checks"))


def verdict(reply: Column) -> Column:
    """struct(passed, issues, checks, feedback) from a verifier's JSON reply; null where it is no object."""
    value = F.try_parse_json(reply)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))

    def text(name: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
        return F.when(kind == "STRING", F.try_variant_get(value, f"$.{name}", "string"))

    made = judge_tokens({k: token(text(k)) for k in PASSING}, token(text("overall")))
    issues = F.try_variant_get(value, "$.check_3_issues", "array<string>")
    counts = F.try_variant_get(value, "$.check_3_counts", "string")
    feedback = F.coalesce(F.try_variant_get(value, "$.feedback", "string"), F.lit(""))
    feedback = F.when(F.size(issues) > 0, F.concat(feedback, F.lit("\nRubric issues: "), F.array_join(issues, "; "))).otherwise(feedback)
    checks = F.when(counts.isNotNull(), F.map_concat(made["checks"], F.create_map(F.lit("check_3_counts"), counts))).otherwise(made["checks"])
    return F.when(is_object, F.struct(made["passed"].alias("passed"), feedback.alias("feedback"), made["issues"].alias("issues"), checks.alias("checks")))


def criterion_valid(c: Column) -> Column:
    """A criterion of at least three characters with a weight from -10 to 10, not 0, whose sign is its category's."""
    fine = (F.length(c["criterion"]) >= 3) & c["weight"].between(-10, 10) & (c["weight"] != 0)
    return F.coalesce(fine & (F.when(c["weight"] > 0, "positive").otherwise("negative") == c["category"]), F.lit(False))


def rubric_valid(criteria: Column) -> Column:
    return F.coalesce((F.size(criteria) > 0) & F.forall(criteria, criterion_valid), F.lit(False))


def rubric_shape(n_positive: Column, n_total: Column, least_positive: int = 4, least_negative: int = 3, least: int = 10, most: int = 20) -> Column:
    """Names of the counts that are off; empty where the rubric's shape is right."""
    n_negative = n_total - n_positive
    return F.array_compact(F.array(
        F.when(n_positive < least_positive, "positive"), F.when(n_negative < least_negative, "negative"), F.when(~n_total.between(least, most), "total"),
    ))


def rubric_counts(criteria: Column) -> Column:
    positive = F.size(F.filter(criteria, lambda c: c["category"] == "positive"))
    return F.struct(positive.alias("n_positive"), (F.size(criteria) - positive).alias("n_negative"), F.size(criteria).alias("n_total"))
