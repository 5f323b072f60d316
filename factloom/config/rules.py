"""The rule registry: language, confidence, maturity, default response and whether the rule is fixed."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    rule_id: str
    language: str
    confidence: str
    maturity: str
    response: str
    immutable: bool = False
    available: bool = True


_TABLE = """
SECURITY-UNSAFE-BOUNDARY common potential experimental Report -
DUPLICATE-CODE-POLICY-DRIFT common stable experimental Fail fixed
CALL-GRAPH-UNRESOLVED-EDGE common potential experimental Report -
CALL-ROOT-POLICY-DRIFT common stable experimental Fail fixed
ARCHITECTURE-FORBIDDEN-DEPENDENCY common stable experimental Report -
ARCHITECTURE-DEPENDENCY-CYCLE common stable experimental Report -
ARCHITECTURE-UNRESOLVED-INTERNAL-IMPORT common stable experimental Report -
COMMON-LINE-90 common stable mature Warn -
COMMON-LINE-100 common stable mature Warn -
COMMON-LINE-120 common stable mature Fail -
COMMON-NO-TABS common stable mature Fail -
JULIA-SYNTAX julia stable mature Fail fixed
JULIA-CLOSING-PAREN-PLACEMENT julia stable mature Fail -
JULIA-JET-POSSIBLE-ERROR julia potential experimental Fail -
JULIA-EMPTY-CATCH julia definite experimental Report -
JULIA-BROAD-CATCH julia probable experimental Report -
JULIA-UNSIGNALED-ARGUMENT-MUTATION julia definite experimental Report -
JULIA-GLOBAL-WRITE julia definite experimental Report -
JULIA-UNREACHABLE-FUNCTION julia probable experimental Report -
JULIA-DUPLICATE-CODE julia definite experimental Report -
JULIA-NAMING julia stable mature Warn -
JULIA-NONCONST-GLOBAL julia stable mature Warn -
JULIA-UNUSED-IMPORT julia definite experimental Report -
JULIA-DECLARATION-ORDER julia stable mature Warn -
JULIA-RETURN-TUPLE julia stable mature Fail -
JULIA-PARAMETERS-FAIL julia stable mature Fail -
JULIA-FUNCTION-LINES-REPORT julia stable mature Report -
JULIA-FUNCTION-LINES-WARN julia stable mature Warn -
JULIA-FUNCTION-LINES-FAIL julia stable mature Fail -
JULIA-CYCLOMATIC-REPORT julia stable mature Report -
JULIA-CYCLOMATIC-WARN julia stable mature Warn -
JULIA-CYCLOMATIC-FAIL julia stable mature Fail -
ODIN-SYNTAX odin stable mature Fail fixed
ODIN-BUILD-FAILED odin stable mature Fail -
ODIN-CLOSING-PAREN-PLACEMENT odin stable mature Fail -
ODIN-NAMING odin stable mature Warn -
ODIN-NONCONST-GLOBAL odin stable mature Warn -
ODIN-UNUSED-IMPORT odin definite experimental Report -
ODIN-UNREACHABLE-PROCEDURE odin probable experimental Report -
ODIN-DUPLICATE-CODE odin definite experimental Report -
ODIN-DECLARATION-ORDER odin stable mature Warn -
ODIN-RETURN-TUPLE odin stable mature Fail -
ODIN-PARAMETERS-WARN odin stable mature Warn -
ODIN-PARAMETERS-FAIL odin stable mature Fail -
ODIN-FUNCTION-LINES-REPORT odin stable mature Report -
ODIN-FUNCTION-LINES-WARN odin stable mature Warn -
ODIN-FUNCTION-LINES-FAIL odin stable mature Fail -
ODIN-CYCLOMATIC-REPORT odin stable mature Report -
ODIN-CYCLOMATIC-WARN odin stable mature Warn -
ODIN-CYCLOMATIC-FAIL odin stable mature Fail -
FUNCTION-METRIC-POLICY-DRIFT common stable mature Fail fixed
NAMING-POLICY-DRIFT common stable mature Fail fixed
ODIN-ALLOCATION-IMPLICIT odin stable experimental Warn -
ODIN-ALLOCATION-UNKNOWN odin stable experimental Fail -
ODIN-ALLOCATION-CONTEXT odin stable experimental Warn -
ODIN-ALLOCATION-HEAP odin stable experimental Warn -
ODIN-ALLOCATION-TEMPORARY odin stable experimental Report -
ODIN-ALLOCATION-CUSTOM odin stable experimental Report -
ODIN-ALLOCATION-DYNAMIC-GROWTH odin potential experimental Report -
ODIN-ALLOCATION-ARENA odin stable experimental Warn -
ODIN-ALLOCATION-HIDDEN odin potential experimental Warn -
ODIN-ALLOCATION-POLICY-DRIFT odin stable experimental Fail fixed
JULIA-DOC-MISSING julia stable mature Fail -
ODIN-DOC-MISSING odin stable mature Fail -
MARKDOWN-SINGLE-H1 markdown stable mature Warn -
MARKDOWN-HEADING-LEVELS markdown stable mature Warn -
MARKDOWN-CODE-FENCE-LANGUAGE markdown stable mature Warn -
MARKDOWN-RELATIVE-LINK markdown stable mature Warn -
MARKDOWN-IMAGE-ALT-TEXT markdown stable mature Warn -
"""

REGISTRY: dict[str, Rule] = {
    f[0]: Rule(*f[:5], f[5] == "fixed") for f in (line.split() for line in _TABLE.strip().splitlines())
}


def engine_of(rule: Rule) -> str:
    """The engine whose status decides whether a rule was evaluated."""
    rid = rule.rule_id
    if rid == "JULIA-JET-POSSIBLE-ERROR":
        return "jet"
    if rid == "ODIN-BUILD-FAILED":
        return "odin-build"
    if rid.startswith("ARCHITECTURE-"):
        return "architecture"
    if rid.startswith("CALL-GRAPH-") or "UNREACHABLE" in rid:
        return "call-graph"
    if "DUPLICATE-CODE" in rid:
        return "duplicate-code"
    return rule.language
