"""Fact relations of a set of source files: one pass over each file, one relation per kind of fact."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.extract import julia, markdown, odin
from factloom.storage import written

_AT = "line long, column long"
SCHEMAS = {
    "declarations": f"path string, language string, name string, qualified_name string, kind string, scope string, {_AT}",
    "imports": f"path string, language string, target string, name string, kind string, {_AT}",
    "references": f"path string, language string, name string, scope string, {_AT}",
    "calls": f"path string, language string, caller string, callee string, kind string, {_AT}",
    "interop": f"path string, language string, symbol string, direction string, library string, calling_convention string, parameter_types array<string>, return_types array<string>, {_AT}",
    "dependencies": f"path string, language string, kind string, target string, {_AT}",
    "modules": "path string, name string, start_line long, end_line long, depth long",
    "clones": "path string, language string, name string, start_line long, end_line long, body string, token_count long, executable_lines long",
    "functions": "path string, language string, name string, start_line long, end_line long, executable_lines long, parameter_count long, cyclomatic long, cognitive long, documented boolean",
    "names": f"path string, language string, kind string, name string, {_AT}",
    "globals": f"path string, language string, name string, {_AT}",
    "order": f"path string, language string, kind string, name string, {_AT}",
    "behavior": f"path string, rule string, subject string, {_AT}",
    "tuples": f"path string, language string, name string, arity long, {_AT}",
    "docs": "path string, language string, name string, doc string, line long",
    "parens": f"path string, language string, {_AT}",
    "allocations": f"path string, rule_id string, operation string, procedure string, allocation_target string, allocator_source string, certainty string, {_AT}",
    "headings": "path string, line long, level long, ord long",
    "fences": f"path string, {_AT}",
    "links": f"path string, image boolean, label string, destination string, target string, relative boolean, {_AT}",
    "structs": "path string, structs long",
    "syntax": "path string, language string, errors long, message string",
    "doc_lines": "path string, line long",
}


def facts_of(path: str, language: str, source: str) -> Iterator[tuple[str, dict]]:
    """All facts of one file."""
    if language == "markdown":
        m = markdown.File(path, source)
        for kind, rows in (("headings", m.headings), ("fences", m.fences), ("links", m.links)):
            yield from ((kind, r) for r in rows)
        return
    file = julia.File(path, source) if language == "julia" else odin.File(path, source) if language == "odin" else None
    if file is None:
        return
    for kind, rows in file.facts.items():
        yield from ((kind, {"language": language, **r}) for r in rows if kind != "docs" or r.get("function", r.get("top", True)))
    yield "structs", {"path": path, "structs": file.structs}
    if getattr(file, "error", None):
        yield "syntax", {"path": path, "language": language, "errors": 1, "message": file.error}
    if language == "julia":
        yield from (("doc_lines", {"path": path, "line": k}) for k in sorted(file.doc_lines))
    elif not getattr(file, "error", None):
        first = next((f["start_line"] for f in file.facts["functions"]), None)
        if first is not None:
            for r in file.facts["declarations"]:
                if r["scope"] is None and r["kind"] in ("constant", "type") and r["line"] > first:
                    yield "order", {"path": path, "language": language, "kind": r["kind"], "name": r["name"], "line": r["line"], "column": r["column"]}


def extract(files: DataFrame) -> dict[str, DataFrame]:
    """Relations of source files ``(path, language, text)``, from one table that is written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, language, text in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "text"))):
                rows = [(kind, n, json.dumps(row)) for n, (kind, row) in enumerate(facts_of(path, language or "", text or ""))]
                if rows:
                    kinds, numbers, bodies = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(numbers, pa.int64()), pa.array(bodies)], ["fact", "ord", "body"])

    table = written(files.select("path", "language", "text").mapInArrow(run, "fact string, ord long, body string"), "facts", "fact")
    return {kind: table.filter(F.col("fact") == kind).select(F.from_json("body", schema).alias("_row"), "ord").select("_row.*", *([] if "ord long" in schema else ["ord"])) for kind, schema in SCHEMAS.items()}
