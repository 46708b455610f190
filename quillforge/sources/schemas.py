"""Schemas of all records; readers take these, nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import StructType

PAPER = "paper_id string, title string, text string, source_path string"
CRITERION = "struct<criterion:string,weight:int,category:string>"
QA_FIELDS = (
    "question_type string, skill_tags array<string>, context string, question string, reference_answer string, "
    f"rubric struct<criteria:array<{CRITERION}>>, paper_id string, metadata variant"
)
VERDICT = "struct<passed:boolean,feedback:string,issues:array<string>,checks:map<string,string>>"
SAMPLE = "struct<answer:string,per_criterion:array<double>,weighted_score:double,judge_feedback:string,infra_error:boolean,truncated:boolean>"
ACCEPTANCE = "struct<accepted:boolean,reasons:array<string>,weak_avg:double,weak_max:double,strong_avg:double,gap:double>"
QA_STRUCT = (
    "struct<question_type:string,skill_tags:array<string>,context:string,question:string,reference_answer:string,"
    f"rubric:struct<criteria:array<{CRITERION}>>,paper_id:string,metadata:variant>"
)
ROUND = (
    f"paper_id string, iteration int, outcome string, qa {QA_STRUCT}, qv_verdict {VERDICT}, weak_samples array<{SAMPLE}>, "
    f"strong_samples array<{SAMPLE}>, acceptance {ACCEPTANCE}, accepted boolean, duration_s double, error string"
)
USAGE = (
    "role string, model string, prompt_tokens bigint, completion_tokens bigint, reasoning_tokens bigint, cached_tokens bigint, "
    "usage_missing boolean, latency_s double, finish_reason string"
)
VARIANT = "variant_id string, parent_id string, iteration int, scores array<double>, mean double"
ITERATION = "iteration int, parent_id string, status string, child_id string, parent_score double, child_score double, changed array<string>, rationale string, note string"
PER_QA = f"paper_id string, question string, samples array<{SAMPLE}>"


def schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
