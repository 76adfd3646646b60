"""Settings of evaluations and gates, as values that are passed on: there are none that are global."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

EVALS = ("llm_judge", "exact_match", "semantic_similarity", "regex", "custom")
MODES = ("hard", "regression", "soft")


@dataclass(frozen=True)
class Eval:
    type: str
    threshold: float = 0.70
    criteria: str | None = None
    model: str | None = None
    pattern: str | None = None
    custom_fn: str | None = None

    def __post_init__(self) -> None:
        if self.type not in EVALS:
            raise ValueError(f"no such evaluation: {self.type}")
        if not 0 <= self.threshold <= 1:
            raise ValueError("a threshold is within 0 and 1")
        for kind, needed in (("regex", "pattern"), ("custom", "custom_fn"), ("llm_judge", "criteria")):
            if self.type == kind and not getattr(self, needed):
                raise ValueError(f"{kind} needs {needed}")


@dataclass(frozen=True)
class Prompt:
    path: str
    name: str | None = None
    evals: tuple[Eval, ...] = ()
    test_cases_file: str | None = None


@dataclass(frozen=True)
class Gate:
    mode: str = "regression"
    regression_threshold: float = 0.05
    hard_threshold: float = 0.70

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"no such mode: {self.mode}")


@dataclass(frozen=True)
class Contract:
    judge_model: str = ""
    judge_provider: str = ""
    path: str = ""
    log_all_results: bool = True
    threshold: float = 0.90
    extra: Mapping[str, str] = field(default_factory=dict)

    def from_environment(self, prefix: str, environment: Mapping[str, str] | None = None) -> Contract:
        """With <prefix>JUDGE_MODEL, <prefix>JUDGE_PROVIDER and <prefix>PATH instead, where they are set."""
        env = os.environ if environment is None else environment
        return replace(self, **{f: env[prefix + f.upper()] for f in ("judge_model", "judge_provider", "path") if prefix + f.upper() in env})


def loaded(values: Mapping) -> tuple[tuple[Prompt, ...], Gate]:
    """Prompts and gate of a mapping, as a suite's settings are read."""
    prompts = tuple(Prompt(**{**p, "evals": tuple(Eval(**e) for e in p.get("evals", ()))}) for p in values.get("prompts", ()))
    return prompts, Gate(**values.get("gate", {}))
