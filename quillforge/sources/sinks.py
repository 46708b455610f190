"""Writers: JSON documents and lines, run output, variants, exports."""

from __future__ import annotations

import difflib
import hashlib
import json
import os
import shutil
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_json(path: str | Path, value: Any) -> None:
    """An indented document; parents are made, unknown types become text."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(value, indent=2, ensure_ascii=False, default=str) + "\n", encoding="utf-8")


def write_jsonl(rows: DataFrame, path: str, mode: str = "error", single: bool = False) -> int:
    """JSON lines as a folder of part files; the number of rows is counted on the way."""
    seen = Observation()
    out = rows.observe(seen, F.count(F.lit(1)).alias("n"))
    (out.coalesce(1) if single else out).write.mode(mode).json(path)
    return seen.get["n"]


def append_jsonl(rows: DataFrame, path: str) -> int:
    return write_jsonl(rows, path, "append")


def write_run(rounds: DataFrame, verdicts: DataFrame, folder: str) -> dict[str, int]:
    """Rounds, accepted questions, filter verdicts and final questions of a run.

    ``rounds`` has accepted and qa; ``verdicts`` has paper_id, passed and qa. Both must be written or
    persisted tables, since each is read more than once.
    """
    base = folder.rstrip("/")
    return {
        "rounds": write_jsonl(rounds, f"{base}/rounds.jsonl", "overwrite"),
        "accepted": write_jsonl(rounds.where("accepted").select("qa.*"), f"{base}/accepted_qa.jsonl", "overwrite"),
        "filter_verdicts": write_jsonl(verdicts, f"{base}/filter_verdicts.jsonl", "overwrite"),
        "final": write_jsonl(verdicts.where("passed").select("qa.*"), f"{base}/final_qa.jsonl", "overwrite"),
    }


def write_variant(folder: str | Path, variant: dict, prompts: dict[str, str], seed: dict[str, str], mutable: tuple[str, ...] = ()) -> None:
    """``<folder>/variants/<id>``: the prompts, a unified diff of the changed ones against the seed, and the variant's record."""
    base = Path(folder) / "variants" / str(variant["variant_id"])
    (base / "prompts").mkdir(parents=True, exist_ok=True)
    diff: list[str] = []
    for name in prompts:
        (base / "prompts" / f"{name}.txt").write_text(prompts[name] + "\n", encoding="utf-8")
    for name in mutable or tuple(prompts):
        if prompts[name] != seed.get(name, ""):
            diff += difflib.unified_diff(seed.get(name, "").splitlines(True), prompts[name].splitlines(True), f"seed/{name}.txt", f"variant/{name}.txt")
    (base / "diff.patch").write_text("".join(diff), encoding="utf-8")
    write_json(base / "variant.json", variant)


def write_population(folder: str | Path, variants: list[dict]) -> None:
    """``<folder>/population.json``: the records of all variants that were kept."""
    write_json(Path(folder) / "population.json", variants)


def append_line(path: str | Path, value: Any) -> None:
    """One more JSON line of a small log that the driver keeps."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with target.open("a", encoding="utf-8") as f:
        f.write(json.dumps(value, ensure_ascii=False, default=str) + "\n")


def file_sha256(path: str | Path) -> str:
    """The digest by which a manifest names an input file."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            digest.update(part)
    return digest.hexdigest()


def complete_export(export: str | Path, base_model: str | Path, weights: tuple[str, ...] = (".safetensors", ".bin", ".pt", ".index.json")) -> list[str]:
    """Copy the base model's files that an export lacks, other than weights; their names, sorted."""
    there = set(os.listdir(export))
    missing = sorted(n for n in os.listdir(base_model) if n not in there and not n.endswith(weights) and (Path(base_model) / n).is_file())
    for name in missing:
        shutil.copy2(Path(base_model) / name, Path(export) / name)
    return missing
