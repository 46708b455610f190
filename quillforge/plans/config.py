"""Run settings: typed defaults, and a YAML file over them."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from typing import Any

from ..functions.gates import Thresholds


@dataclass(frozen=True)
class Role:
    """One model endpoint. Thinking and a reasoning effort of none exclude each other."""

    model: str
    temperature: float = 1.0
    max_tokens: int = 4000
    thinking: bool = False
    reasoning_effort: str | None = None
    timeout_s: float = 600.0
    top_p: float | None = None
    top_k: int | None = None
    presence_penalty: float | None = None
    endpoint: str = ""
    key_variable: str = ""

    def __post_init__(self):
        if self.thinking and self.reasoning_effort == "none":
            raise ValueError("thinking needs a reasoning effort")


@dataclass(frozen=True)
class FinalFilter:
    least_positive: int = 4
    least_negative: int = 3
    least_total: int = 10
    most_total: int = 20


@dataclass(frozen=True)
class Meta:
    """Settings of the outer loop; a file must give all of them."""

    iterations: int = 4
    temperature: float = 0.1
    n_train: int = 50
    n_val: int = 25
    minibatch: int = 5
    samples_per_paper: int = 4
    max_rounds: int = 1
    least_scored: float = 0.8
    most_prompt_chars: int = 20_000
    edit_retries: int = 2


#: The roles whose thinking, budget and sampling are one setting, so that they differ by model only.
SOLVERS = ("weak_solver", "strong_solver")


@dataclass(frozen=True)
class Generation:
    """How both solvers generate; a file must give the first three."""

    thinking: bool
    max_tokens: int
    temperature: float
    top_p: float | None = None
    top_k: int | None = None
    presence_penalty: float | None = None


def with_generation(roles: dict[str, Role], made: Generation) -> dict[str, Role]:
    """The roles with both solvers' generation settings replaced."""
    own = {f.name: getattr(made, f.name) for f in fields(Generation)}
    return {name: replace(role, **own) if name in SOLVERS else role for name, role in roles.items()}


@dataclass(frozen=True)
class Settings:
    acceptance: Thresholds = field(default_factory=Thresholds)
    final_filter: FinalFilter = field(default_factory=FinalFilter)
    meta: Meta = field(default_factory=Meta)
    max_iterations: int = 15
    samples: int = 3
    infra_retries: int = 2
    test_size: int = 100
    seed: int = 42
    roles: dict[str, Role] = field(default_factory=dict)


#: A role of a file that names no limit gets this one.
FILE_MAX_TOKENS = 2000


def _pick(cls, values: dict[str, Any], whole: bool = False):
    names = {f.name for f in fields(cls)}
    if unknown := set(values) - names:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    if whole and (missing := names - set(values)):
        raise ValueError(f"missing settings: {', '.join(sorted(missing))}")
    return cls(**values)


def from_dict(values: dict[str, Any]) -> Settings:
    values = dict(values)
    out: dict[str, Any] = {}
    for name, cls, whole in (("acceptance", Thresholds, False), ("final_filter", FinalFilter, False), ("meta", Meta, True)):
        if name in values:
            out[name] = _pick(cls, values.pop(name), whole)
    out["roles"] = {k: _pick(Role, {"max_tokens": FILE_MAX_TOKENS, **v}) for k, v in values.pop("roles", {}).items()}
    if "solver_generation" in values:
        made = values.pop("solver_generation")
        if missing := {"thinking", "max_tokens", "temperature"} - set(made):
            raise ValueError(f"missing settings: {', '.join(sorted(missing))}")
        out["roles"] = with_generation(out["roles"], _pick(Generation, made))
    return _pick(Settings, {**values, **out})


def load(path: str) -> Settings:
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_dict(yaml.safe_load(f) or {})


@dataclass(frozen=True)
class BatchShape:
    """Sizes of a policy-gradient step. A step's completions must fill whole rounds of all devices."""

    prompts: int = 16
    generations: int = 8
    per_device: int = 2
    devices: int = 2

    def accumulation(self) -> int:
        total, at_once = self.prompts * self.generations, self.per_device * self.devices
        if total % at_once:
            raise ValueError(f"{total} completions don't divide by {at_once}")
        return total // at_once
