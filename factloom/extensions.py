"""Extensions: analyses of one's own over the fact relations, isolated and ordered."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from factloom.config.rules import REGISTRY, Rule

API = "1.8.0"
PHASES = ("after-discovery", "after-language-analysis", "after-repository-analysis")


class ExtensionError(ValueError):
    """An extension breaks its contract."""


@dataclass
class ExtensionResult:
    extension_id: str
    phase: str
    status: str = "complete"
    diagnostics: DataFrame | None = None
    artifacts: dict = field(default_factory=dict)
    message: str | None = None


class Extension(ABC):
    """An analysis: facts by name and results of its dependencies in, findings out."""

    api_version = API
    phases: tuple[str, ...] = ("after-repository-analysis",)
    rules: tuple[Rule, ...] = ()
    dependencies: tuple[str, ...] = ()

    @property
    @abstractmethod
    def extension_id(self) -> str: ...

    @abstractmethod
    def analyze(self, context: dict[str, DataFrame], prior: dict[str, ExtensionResult]) -> ExtensionResult: ...


def ordered(extensions: list[Extension]) -> list[Extension]:
    """Dependencies first, configured order otherwise; a cycle is an error that names its members."""
    left, done, out = list(extensions), set(), []
    while left:
        ready = [e for e in left if set(e.dependencies) <= done]
        if not ready:
            raise ExtensionError("extension dependencies form a cycle: " + ", ".join(e.extension_id for e in left))
        out += ready
        done |= {e.extension_id for e in ready}
        left = [e for e in left if e not in ready]
    return out


def validated(extensions: list[Extension]) -> dict[str, Rule]:
    """Check versions, identities, dependencies and rule ownership; returns the rules that extensions own."""
    ids = [e.extension_id for e in extensions]
    owned: dict[str, Rule] = {}
    for e in extensions:
        if e.api_version != API:
            raise ExtensionError(f"{e.extension_id} needs version {e.api_version} of the interface; this is {API}")
        if not e.extension_id or ids.count(e.extension_id) > 1:
            raise ExtensionError(f"duplicate extension: {e.extension_id}")
        if set(e.dependencies) - set(ids):
            raise ExtensionError(f"{e.extension_id} depends on unknown extensions")
        if not set(e.phases) <= set(PHASES):
            raise ExtensionError(f"{e.extension_id} has an unknown phase")
        for rule in e.rules:
            if rule.rule_id in REGISTRY or rule.rule_id in owned:
                raise ExtensionError(f"{e.extension_id} can't own rule {rule.rule_id}")
            owned[rule.rule_id] = rule
    return owned


def run_phase(extensions: list[Extension], phase: str, context: dict[str, DataFrame], results: list[ExtensionResult]) -> list[ExtensionResult]:
    """Run the extensions of a phase; one that fails gets a failed result and disturbs no other.

    Findings are evaluated here, so a failure that only shows in execution belongs to its extension.
    """
    out: list[ExtensionResult] = []
    for e in ordered(extensions):
        if phase not in e.phases:
            continue
        try:
            latest = {r.extension_id: r for r in [*results, *out]}
            result = e.analyze(dict(context), {d: latest[d] for d in e.dependencies if d in latest})
            if not isinstance(result, ExtensionResult) or result.extension_id != e.extension_id or result.phase != phase:
                raise ExtensionError("the result names another extension or phase")
            if result.status not in ("complete", "incomplete", "not-applicable", "failed"):
                raise ExtensionError(f"unknown status {result.status}")
            json.dumps(result.artifacts)
            if result.diagnostics is not None:
                mine = [r.rule_id for r in e.rules]
                stray = [r["rule_id"] for r in result.diagnostics.select("rule_id").distinct().limit(1000).collect() if r["rule_id"] not in mine]
                if stray:
                    raise ExtensionError(f"findings of rules that it doesn't own: {', '.join(sorted(stray))}")
        except Exception as error:  # noqa: BLE001 - any fault of an extension is its result
            result = ExtensionResult(e.extension_id, phase, "failed", message=f"{type(error).__name__}: {error}")
        out.append(result)
    return out
