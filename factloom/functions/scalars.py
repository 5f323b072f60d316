"""Scalar expressions: names, types, evidence, paths and texts.  All of them are built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RESPONSES = ("Ignore", "Report", "Warn", "Fail")

_GREEK = "Α-Ωα-ω"
_LOW, _UP, _ANY = f"a-z{_GREEK}", f"A-Z{_GREEK}", f"A-Za-z{_GREEK}"
_PASCAL = f"[{_UP}][{_ANY}0-9]*"
_SCREAMING = f"[{_UP}][{_UP}0-9]*(_[{_UP}0-9]+)*"

#: Casing patterns by name; Greek letters count as either case.  Identifiers have lost leading underscores
#: and one trailing exclamation mark when they are matched.
CASINGS = {
    "any": "^.*$",
    "lowercase": f"^[{_LOW}][{_LOW}0-9_]*$",
    "snake_case": f"^[{_LOW}][{_LOW}0-9]*(_[{_LOW}0-9]+)*$",
    "camel_case": f"^{_PASCAL}$",
    "camel_or_screaming": f"^({_PASCAL}|{_SCREAMING})$",
    "ada_case": f"^[{_UP}][{_LOW}0-9]*(_[{_UP}][{_LOW}0-9]*)*$",
    "screaming_snake_case": f"^{_SCREAMING}$",
}

ABI_TYPES = {
    "Cchar": "i8",
    "Cuchar": "u8",
    "Cshort": "i16",
    "Cushort": "u16",
    "Cint": "i32",
    "Cuint": "u32",
    "Clonglong": "i64",
    "Culonglong": "u64",
    "Cfloat": "f32",
    "Cdouble": "f64",
    "Cvoid": "void",
    "Cstring": "cstring",
}

EVIDENCE = dict(
    line.strip().split(" = ", 1)
    for line in """
    corroborated = Static test reachability and runtime line coverage agree.
    uncovered = Neither static test reachability nor runtime execution was observed.
    unavailable = Neither static test roots nor runtime lines are available.
    static-only = Static test reachability was not corroborated at runtime.
    static-unavailable = No static test root exists for this language.
    runtime-only = Runtime coverage exists outside the resolved test-call closure.
    runtime-unavailable = No LCOV line intersects this declaration.
    """.strip().splitlines()
)


def lookup(column: Column, table: dict[str, str]) -> Column:
    """The table's value for the column, null where it has none."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.element_at(F.create_map(*pairs), column) if pairs else F.lit(None).cast("string")


def terminal_name(name: Column) -> Column:
    """What follows the last dot; empty for null."""
    return F.coalesce(F.substring_index(name, ".", -1), F.lit(""))


def response_rank(response: Column) -> Column:
    """0 for Ignore to 3 for Fail, whatever the case; null for anything else."""
    return lookup(F.lower(response), {r.lower(): str(k) for k, r in enumerate(RESPONSES)}).cast("int")


def response_name(response: Column) -> Column:
    return F.lower(response)


def meets_threshold(response: Column, threshold: Column) -> Column:
    return response_rank(response) >= response_rank(threshold)


def abi_type(name: Column) -> Column:
    """Neutral name of a foreign-call type: table entries, ``Ptr{T}`` as ``^t``, anything else as it stands."""
    name = F.replace(name, F.lit(" "), F.lit(""))
    inner = F.regexp_extract(name, r"^Ptr\{(.*)\}$", 1)
    plain = F.coalesce(lookup(name, ABI_TYPES), name)
    pointed = F.concat(F.lit("^"), F.coalesce(lookup(inner, ABI_TYPES), inner))
    return F.when(name.rlike(r"^Ptr\{.*\}$"), pointed).otherwise(plain)


def abi_returns(name: Column) -> Column:
    """Return types as a list: none for void."""
    kind = abi_type(name)
    return F.when(kind == "void", F.array().cast("array<string>")).otherwise(F.array(kind))


def evidence_class(static: Column, runtime: Column) -> Column:
    """Seven labels from two three-valued observations."""
    return (
        F.when(static & runtime, "corroborated")
        .when(static & ~runtime, "static-only")
        .when(~static & runtime, "runtime-only")
        .when(~static & ~runtime, "uncovered")
        .when(static.isNotNull(), "runtime-unavailable")
        .when(runtime.isNotNull(), "static-unavailable")
        .otherwise("unavailable")
    )


def evidence_explanation(label: Column) -> Column:
    return F.concat(lookup(label, EVIDENCE), F.lit(" Reachability and line execution do not prove assertion quality."))


def is_gap(static: Column, runtime: Column) -> Column:
    """Either observation is false; a missing one is no gap."""
    return F.coalesce(~static, F.lit(False)) | F.coalesce(~runtime, F.lit(False))


def risk_score(cyclomatic: Column, lines: Column, boundary: Column) -> Column:
    """Complexity, one for each started ten lines, and five at a boundary."""
    return (cyclomatic + F.ceil(lines / F.lit(10.0)) + F.when(boundary, 5).otherwise(0)).cast("long")


def fingerprint(body: Column) -> Column:
    return F.sha2(body, 256)


def excluded(path: Column, prefixes: list[str]) -> Column:
    """Whether the path is one of the prefixes or lies below one; separators are normalised, nothing is a glob."""
    clean = F.regexp_replace(path, r"\\", "/")
    out = F.lit(False)
    for prefix in prefixes:
        p = prefix.replace("\\", "/").rstrip("/")
        out = out | (clean == p) | clean.startswith(p + "/")
    return out


def repository_path(path: Column, root: str) -> Column:
    """The path relative to the root; null where it lies outside or climbs out."""
    base = root.rstrip("/") + "/"
    clean = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"(^|/)\./", "$1")
    relative = F.when(clean.startswith(base), F.substring(clean, len(base) + 1, 1 << 30)).when(~clean.startswith("/"), clean)
    return F.when(~relative.rlike(r"(^|/)\.\.(/|$)") & (relative != ""), relative)


def valid_name(name: Column, casing: str, ignored_names: tuple[str, ...] = (), ignored_patterns: tuple[str, ...] = ()) -> Column:
    """Whether an identifier follows a casing, is ignored by name, or matches an ignored pattern anywhere."""
    bare = F.regexp_replace(F.regexp_replace(name, r"!$", ""), r"^_+", "")
    ok = F.when(bare == "", name == "_").otherwise(bare.rlike(CASINGS[casing]))
    if ignored_names:
        ok = ok | name.isin(*ignored_names)
    for pattern in ignored_patterns:
        ok = ok | name.rlike(pattern)
    return ok


def markdown_cell(value: Column) -> Column:
    """Text for a table cell: bars escaped, line breaks as blanks, null as a dash."""
    text = F.replace(F.replace(F.replace(value.cast("string"), F.lit("|"), F.lit("\\|")), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" "))
    return F.coalesce(text, F.lit("-"))


def markdown_heading(value: Column) -> Column:
    return F.replace(value.cast("string"), F.lit("`"), F.lit("'"))


def measurement(measured: Column, allowed: Column) -> Column:
    """``-``, the value, or the value over the limit."""
    both = F.concat(measured.cast("string"), F.lit(" / "), allowed.cast("string"), F.lit(" allowed"))
    return F.coalesce(both, measured.cast("string"), F.lit("-"))
