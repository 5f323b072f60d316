"""Settings of an analysis: plain data, checked before a plan is built."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, get_args, get_origin, get_type_hints

from factloom.config.rules import REGISTRY, Rule
from factloom.functions.scalars import CASINGS, RESPONSES

LANGUAGES = ("julia", "odin")
METRICS = ("lines", "cyclomatic")
KINDS = {
    "julia": {"module", "type", "function", "constant", "parameter", "variable", "field"},
    "odin": {"import", "procedure", "type", "constant", "parameter", "variable", "field", "enum_value"},
}
CATEGORIES = {"implicit", "unknown", "context", "heap", "temporary", "custom", "dynamic_growth", "arena", "hidden"}
ROOTS = {"production", "test", "callback", "bridge"}


class SettingsError(ValueError):
    """Settings contradict themselves or the registry."""


def check(ok: bool, message: str) -> None:
    if not ok:
        raise SettingsError(message)


def distinct(values: list, what: str) -> None:
    seen: set = set()
    for v in values:
        check(v not in seen, f"duplicate {what}: {v}")
        seen.add(v)


def repository_path(path: str, what: str) -> None:
    """A normalised path below the root."""
    check(bool(path) and not path.startswith("/") and "\\" not in path and ".." not in path.split("/") and not path.endswith("/") and (path == "." or "." not in path.split("/")), f"{what} must be a normalised path in the repository: {path!r}")


@dataclass
class RuleSetting:
    rule_id: str
    enabled: bool = True
    response: str = "Warn"


@dataclass
class Tiers:
    report: int
    warn: int
    fail: int


@dataclass
class LineWidths:
    warning: int = 90
    discouraged: int = 100
    hard: int = 120


@dataclass
class NamingConvention:
    language: str
    kind: str
    casing: str
    ignored_names: list[str] = field(default_factory=list)
    ignored_patterns: list[str] = field(default_factory=list)
    allow_constructor_names: bool = False


@dataclass
class ReviewedPolicy:
    """A selector with a response; which selector columns count depends on the list it stands in."""

    id: str
    path: str
    response: str
    reason: str
    rule_id: str = ""
    subject: str | None = None
    operation: str | None = None
    procedure: str | None = None
    allocation_target: str | None = None
    allocator_source: str | None = None
    certainty: str | None = None
    min_matches: int = 1
    max_matches: int = 1


@dataclass
class Contract:
    """A lifetime contract; null columns match anything."""

    id: str
    category: str
    ownership: str
    lifetime: str
    reason: str
    operation: str | None = None
    allocator_source: str | None = None
    release_operation: str | None = None
    allows_escape: bool = False


@dataclass
class SecurityContract:
    id: str
    language: str
    declaration: str
    category: str


@dataclass
class EntryPoint:
    id: str
    language: str
    name: str
    category: str = "production"


@dataclass
class Layer:
    name: str
    paths: list[str]


@dataclass
class Clones:
    enabled: bool = False
    min_tokens: int = 40
    min_lines: int = 6
    min_occurrences: int = 2
    excludes: list[str] = field(default_factory=list)


@dataclass
class Coverage:
    enabled: bool = False
    traces: list[str] = field(default_factory=list)
    high_risk_limit: int = 20


@dataclass
class External:
    """JSON files of facts that other programs made: native summaries, inference reports, build records."""

    native: list[str] = field(default_factory=list)
    inference: list[str] = field(default_factory=list)
    builds: list[str] = field(default_factory=list)


@dataclass
class Profile:
    name: str
    excludes: list[str] = field(default_factory=list)


def _conventions() -> list[NamingConvention]:
    table = """
    julia module camel_case; julia type camel_case; julia function snake_case; julia constant screaming_snake_case; julia parameter snake_case
    julia variable snake_case; julia field snake_case; odin import snake_case; odin procedure snake_case; odin type ada_case
    odin constant screaming_snake_case; odin parameter snake_case; odin variable snake_case; odin field snake_case; odin enum_value ada_case
    """
    return [NamingConvention(*entry.split()) for entry in re.split(r"[;\n]", table) if entry.strip()]


@dataclass
class Settings:
    threshold: str = "Fail"
    rules: list[RuleSetting] = field(default_factory=lambda: [RuleSetting(r.rule_id, True, r.response) for r in REGISTRY.values()])
    widths: LineWidths = field(default_factory=LineWidths)
    metric_tiers: dict[str, Tiers] = field(default_factory=lambda: {"julia/lines": Tiers(20, 45, 65), "odin/lines": Tiers(20, 45, 65), "julia/cyclomatic": Tiers(10, 13, 16), "odin/cyclomatic": Tiers(10, 15, 18)})
    cognitive_maximum: int = 15
    julia_parameters: int = 8
    odin_parameters_warn: int = 5
    odin_parameters_fail: int = 8
    julia_tuple: int = 2
    odin_tuple: int = 2
    documentation_pattern: str = r"\S"
    conventions: list[NamingConvention] = field(default_factory=_conventions)
    allocator_patterns: dict[str, str] = field(default_factory=lambda: {"context.allocator": "context"})
    metric_policies: list[ReviewedPolicy] = field(default_factory=list)
    naming_policies: list[ReviewedPolicy] = field(default_factory=list)
    clone_policies: list[ReviewedPolicy] = field(default_factory=list)
    allocation_policies: list[ReviewedPolicy] = field(default_factory=list)
    clones: Clones = field(default_factory=Clones)
    coverage: Coverage = field(default_factory=Coverage)
    external: External = field(default_factory=External)
    lifetime_enabled: bool = False
    contracts: list[Contract] = field(default_factory=list)
    security_enabled: bool = False
    sources: list[SecurityContract] = field(default_factory=list)
    sinks: list[SecurityContract] = field(default_factory=list)
    sanitizers: list[SecurityContract] = field(default_factory=list)
    entry_points: list[EntryPoint] = field(default_factory=list)
    layers: list[Layer] = field(default_factory=list)
    allowed_dependencies: list[list[str]] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)
    profiles: list[Profile] = field(default_factory=list)
    profile: str | None = None
    warning_limit: int = 50
    report_limit: int = 50

    def rule(self, rule_id: str) -> RuleSetting:
        return next(r for r in self.rules if r.rule_id == rule_id)

    def all_excludes(self) -> list[str]:
        return [*self.excludes, *(x for p in self.profiles if p.name == self.profile for x in p.excludes)]


def validate(settings: Settings, owned: dict[str, Rule] | None = None) -> Settings:
    """Raise on the first contradiction; ``owned`` adds the rules of extensions to the registry."""
    registry = {**REGISTRY, **(owned or {})}
    s = settings
    check(s.threshold in RESPONSES[1:], f"the threshold can't be {s.threshold}")
    distinct([r.rule_id for r in s.rules], "rule")
    for r in s.rules:
        check(r.rule_id in registry, f"unknown rule: {r.rule_id}")
        check(r.response in RESPONSES, f"unknown response of {r.rule_id}: {r.response}")
        rule = registry[r.rule_id]
        check(not rule.immutable or (r.enabled and r.response == "Fail"), f"{r.rule_id} must be enabled with response Fail")
        check(rule.available or not r.enabled, f"{r.rule_id} is not available")
    missing = sorted(set(registry) - {r.rule_id for r in s.rules})
    check(not missing, f"missing rules: {', '.join(missing)}")
    check(0 < s.widths.warning < s.widths.discouraged < s.widths.hard, "line widths must increase")
    for name, t in s.metric_tiers.items():
        check(name in {f"{a}/{b}" for a in LANGUAGES for b in METRICS}, f"unknown metric: {name}")
        check(0 < t.report < t.warn < t.fail, f"tiers of {name} must increase")
    check(0 < s.odin_parameters_warn < s.odin_parameters_fail and s.julia_parameters > 0, "parameter limits must increase")
    check(min(s.julia_tuple, s.odin_tuple, s.cognitive_maximum) > 0, "limits must be positive")
    check(not re.search(s.documentation_pattern, ""), "the documentation pattern must not match empty text")
    distinct([(c.language, c.kind) for c in s.conventions], "naming convention")
    for c in s.conventions:
        check(c.kind in KINDS.get(c.language, ()), f"unknown kind of name: {c.language} {c.kind}")
        check(c.casing in CASINGS, f"unknown casing: {c.casing}")
        check(not c.allow_constructor_names or (c.language, c.kind) == ("julia", "function"), "constructor names are for Julia functions only")
        for p in c.ignored_patterns:
            re.compile(p)
    for what, policies in (("metric", s.metric_policies), ("naming", s.naming_policies), ("clone", s.clone_policies), ("allocation", s.allocation_policies)):
        distinct([p.id for p in policies], f"{what} policy")
        distinct([(p.rule_id, p.path, p.subject, p.operation, p.procedure, p.allocation_target, p.allocator_source, p.certainty) for p in policies if what in ("metric", "naming")], f"{what} policy selector")
        for p in policies:
            check(bool(p.reason.strip()), f"policy {p.id} needs a reason")
            check(p.response in RESPONSES and (what != "clone" or p.response != "Ignore"), f"policy {p.id} can't have response {p.response}")
            check(0 <= p.min_matches <= p.max_matches and p.max_matches > 0, f"bounds of policy {p.id}")
            if what != "clone":
                repository_path(p.path, f"policy {p.id}")
            else:
                check(bool(re.fullmatch(r"[0-9a-f]{64}", p.subject or "")), f"policy {p.id} needs a SHA-256 fingerprint")
    for source, category in s.allocator_patterns.items():
        check(bool(source) and category in CATEGORIES, f"unknown allocation category: {category}")
    distinct([c.id for c in s.contracts], "lifetime contract")
    for c in s.contracts:
        check(c.category in CATEGORIES and bool(c.reason.strip()), f"contract {c.id}")
    distinct([c.id for c in [*s.sources, *s.sinks, *s.sanitizers]], "security contract")
    for c in [*s.sources, *s.sinks, *s.sanitizers]:
        check(c.language in LANGUAGES and bool(c.declaration), f"security contract {c.id}")
    distinct([e.id for e in s.entry_points], "entry point")
    for e in s.entry_points:
        check(e.language in LANGUAGES and e.category in ROOTS, f"entry point {e.id}")
    distinct([x.name for x in s.layers], "architecture layer")
    distinct([p for x in s.layers for p in x.paths], "layer path")
    for layer in s.layers:
        check(bool(layer.paths), f"layer {layer.name} must own a path")
        for p in layer.paths:
            repository_path(p, f"layer {layer.name}")
    names = {x.name for x in s.layers}
    for pair in s.allowed_dependencies:
        check(len(pair) == 2 and set(pair) <= names, f"unknown layer in {pair}")
    distinct([p.name for p in s.profiles], "profile")
    check(s.profile is None or s.profile in {p.name for p in s.profiles}, f"unknown profile: {s.profile}")
    check(min(s.clones.min_tokens, s.clones.min_lines) > 0 and s.clones.min_occurrences > 1, "clone limits")
    check(s.coverage.high_risk_limit > 0 and min(s.warning_limit, s.report_limit) >= 0, "report limits")
    return s


def _build(kind: Any, value: Any) -> Any:
    origin, args = get_origin(kind), get_args(kind)
    if is_dataclass(kind) and isinstance(value, dict):
        hints = get_type_hints(kind)
        unknown = set(value) - {f.name for f in fields(kind)}
        check(not unknown, f"unknown settings: {', '.join(sorted(unknown))}")
        return kind(**{k: _build(hints[k], v) for k, v in value.items()})
    if origin is list and isinstance(value, list):
        return [_build(args[0], v) for v in value]
    if origin is dict and isinstance(value, dict):
        return {k: _build(args[1], v) for k, v in value.items()}
    return value


def load(path: str | None = None, profile: str | None = None) -> Settings:
    """Settings from a JSON file (nothing is evaluated), the packaged ones without a path."""
    settings = Settings()
    if path:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        rules = {r["rule_id"]: r for r in raw.pop("rules", [])}
        settings = _build(Settings, raw)
        for r in settings.rules:
            for k, v in rules.pop(r.rule_id, {}).items():
                setattr(r, k, v)
        settings.rules += [_build(RuleSetting, r) for r in rules.values()]
    if profile:
        settings.profile = profile
    return validate(settings)
