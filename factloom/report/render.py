"""Sinks: JSON, text and Markdown.  All rows that are shown are limited or summaries before they are fetched."""

from __future__ import annotations

import json
import os
import sys
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.config.settings import Settings
from factloom.functions import scalars as S
from factloom.operators import aggregates as A
from factloom.operators import findings as D
from factloom.plans.analysis import Report

STYLES = {"Report": "36", "Warn": "33", "Fail": "31"}


def use_color(mode: str, stream: TextIO) -> bool:
    """``always``, ``never``, or ``auto``: a terminal without NO_COLOR."""
    return mode == "always" or (mode == "auto" and stream.isatty() and not os.environ.get("NO_COLOR"))


def styled(text: str, style: str, on: bool) -> str:
    return f"\x1b[{style}m{text}\x1b[0m" if on else text


def write_json(report: Report, out: TextIO) -> None:
    """One document; responses in lower case, never any colour.  Rows are streamed, one relation at a time."""
    out.write('{\n  "root": ' + json.dumps(report.root) + f',\n  "exit_code": {report.exit_code}')
    for name, frame in sorted(report.frames.items()):
        if "response" in frame.columns:
            frame = frame.withColumn("response", S.response_name(F.col("response")))
        out.write(f",\n  {json.dumps(name)}: [")
        order = [c for c in D.ORDER if c in frame.columns]
        rows = (frame.orderBy(*order) if order else frame).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))
        for k, row in enumerate(rows.toLocalIterator()):
            out.write(("," if k else "") + "\n    " + row["row"])
        out.write("]")
    extensions = [{"extension_id": r.extension_id, "phase": r.phase, "status": r.status, "message": r.message, "artifacts": r.artifacts} for r in report.extensions]
    out.write(',\n  "extensions": ' + json.dumps(extensions) + "\n}\n")


def write_json_tables(report: Report, folder: str) -> None:
    """Every relation as a folder of JSON lines, written by the executors."""
    for name, frame in report.frames.items():
        frame.write.mode("overwrite").json(f"{folder}/{name}")


def write_text(report: Report, out: TextIO, settings: Settings, color: str = "auto") -> None:
    on = use_color(color, out)
    frames = report.frames
    out.write(f"Analysis of {report.root}\n\nENGINES\n")
    for r in frames["engines"].orderBy("name").collect():
        out.write(f"  {r['name']}: {r['status']}\n")
    out.write("\nRULES\n")
    for r in frames["rules"].orderBy("rule_id").collect():
        out.write(f"  {r['rule_id']}: {r['response'].lower()} {r['status']}, {r['files_checked']} files, {r['findings']} findings\n")
    ignored = frames["ignored"].orderBy("rule_id").collect()
    if ignored:
        out.write("\nIGNORED\n" + "".join(f"  {r['rule_id']}: {r['ignored']}\n" for r in ignored))
    limits = {"Report": settings.report_limit, "Warn": settings.warning_limit, "Fail": None}
    for response, limit in limits.items():
        mine = frames["diagnostics"].filter(F.col("response") == response)
        omitted = 0
        if limit is not None:
            mine, rest = D.display(mine, limit)
            omitted = rest.first()[0]
        path = None
        for r in mine.orderBy(*D.ORDER).toLocalIterator():
            if path is None:
                out.write("\n" + styled(response.upper(), STYLES[response], on) + "\n")
            if r["path"] != path:
                path = r["path"]
                out.write(f"  {path}\n")
            reviewed = f" [REVIEWED: {r['reviewed_policy_id']}]" if r["reviewed_policy_id"] else ""
            label = styled(r["rule_id"], STYLES[response], on)
            out.write(f"    {r['line']}:{r['column']} {label} {r['message']}{reviewed}\n")
        if omitted:
            out.write(f"  {omitted} more non-allocation {response.upper()} findings omitted\n")
    failed = [r for r in report.extensions if r.status == "failed"]
    if failed:
        out.write("\nTOOL FAILURES\n" + "".join(f"  {r.extension_id}: {r.message}\n" for r in failed))
    out.write("\nSUMMARY findings/files/rules\n")
    rows = {r["response"]: r for r in D.severity_matrix(frames["diagnostics"]).collect()}
    for response in STYLES:
        r = rows[response]
        out.write(f"  {response} {r['findings']}/{r['files']}/{r['rules']}\n")
    reviewed = frames["diagnostics"].filter("reviewed_policy_id is not null").agg(F.count("*"), F.countDistinct("reviewed_policy_id")).first()
    out.write(f"  Reviewed {reviewed[0]} findings by {reviewed[1]} policies\n\nexit {report.exit_code}\n")


def _rows(out: TextIO, title: str, frame: DataFrame, columns: list[str], order: list | None = None, limit: int | None = None) -> None:
    out.write(f"\n## {title}\n\n| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n")
    text = lambda c: F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ", ") if frame.schema[c].dataType.typeName() == "array" else F.to_json(c) if frame.schema[c].dataType.typeName() == "struct" else F.col(c)
    ranked = frame.orderBy(*(order or columns[:1]))
    shown = (ranked.limit(limit) if limit else ranked).select(*(S.markdown_cell(text(c)).alias(c) for c in columns))
    for r in shown.toLocalIterator():
        out.write("| " + " | ".join(r) + " |\n")


def function_status(frame: DataFrame, settings: Settings) -> DataFrame:
    """``exceeds maximum``, ``review`` or ``within thresholds`` for each function."""
    s, over, look = settings, F.lit(False), F.lit(False)
    for language in ("julia", "odin"):
        here = F.col("language") == language
        lines, cyclomatic = s.metric_tiers[f"{language}/lines"], s.metric_tiers[f"{language}/cyclomatic"]
        most = s.julia_parameters if language == "julia" else s.odin_parameters_fail
        over = over | (here & ((F.col("executable_lines") > lines.fail) | (F.col("parameter_count") > most) | (F.col("cyclomatic") > cyclomatic.fail) | F.coalesce(F.col("cognitive") > s.cognitive_maximum, F.lit(False))))
        look = look | (here & ((F.col("executable_lines") > lines.report) | (F.col("cyclomatic") > cyclomatic.report) | (F.lit(language == "odin") & (F.col("parameter_count") > s.odin_parameters_warn))))
    return frame.withColumn("status", F.when(over, "exceeds maximum").when(look, "review").otherwise("within thresholds"))


def file_severities(files: DataFrame, found: DataFrame) -> DataFrame:
    """Files with counts of findings by response, zero where there are none."""
    counts = found.groupBy("path").agg(*(F.count_if(F.col("response") == r).alias(r) for r in STYLES))
    return files.join(counts, "path", "left").fillna(0, list(STYLES))


def write_markdown(report: Report, out: TextIO, settings: Settings, full: bool = False) -> None:
    """The compact document, with all inventories if ``full``."""
    frames = report.frames
    found = frames["diagnostics"]
    functions = function_status(frames["functions"], settings)
    bad = found.filter("response in ('Warn', 'Fail')").select("path").distinct()
    totals = frames["files"].agg(F.count("*"), F.sum("source_lines")).first()
    clean = frames["files"].join(bad, "path", "left_anti").count()
    out.write(f"# Analysis of {report.root}\n\n## Summary\n\n- Files: {totals[0]}\n- Source lines: {totals[1] or 0}\n- Clean files: {clean}\n")
    for r in functions.groupBy("status").agg(F.count("*").alias("n")).orderBy("status").collect():
        out.write(f"- Functions {r['status']}: {r['n']}\n")
    for r in D.severity_matrix(found).collect():
        out.write(f"- {r['response']}: {r['findings']}\n")
    reviewed = found.filter("reviewed_policy_id is not null").agg(F.count("*"), F.countDistinct("reviewed_policy_id")).first()
    out.write(f"- Ignored: {frames['ignored'].agg(F.sum('ignored')).first()[0] or 0}\n- Reviewed: {reviewed[0]} findings by {reviewed[1]} policies\n- Exit code: {report.exit_code}\n")
    _rows(out, "Languages", frames["languages"], ["language", "files"])
    rounded = frames["statistics"].withColumn("density", F.bround("density", 4))
    _rows(out, "Statistics", rounded, ["language", "files", "functions", "struct_count", "physical_lines", "blank_lines", "comment_lines", "code_lines", "complexity", "density"])
    each = frames["statistics"].filter("language in ('odin', 'julia', 'total')")
    last = [F.col("language") == "total", F.desc("language")]
    cocomo, locomo = A.cocomo(F.col("code_lines")), A.locomo(F.col("code_lines"), F.col("complexity"))
    _rows(out, "COCOMO", each.select("language", *(F.bround(v, 2 if k == "cost" else 3).alias(k) for k, v in cocomo.items())), ["language", *cocomo], last)
    _rows(out, "LOCOMO", each.select("language", *(F.bround(v, 2 if k == "cost" else 3).alias(k) for k, v in locomo.items())), ["language", *locomo], last)
    _rows(out, "Engines", frames["engines"], ["name", "status", "message"])
    _rows(out, "Rules", frames["rules"], ["rule_id", "response", "status", "files_checked", "findings"])
    _rows(out, "Ignored rules", frames["ignored"], ["rule_id", "ignored"])
    _rows(out, "Files", file_severities(frames["files"], found), ["path", "language", "source_lines", "function_count", "struct_count", *STYLES])
    _rows(out, "Functions", functions, ["path", "start_line", "name", "executable_lines", "parameter_count", "cyclomatic", "cognitive", "status"], ["path", "start_line", "name"])
    _findings(out, found)
    ledger = found.unionByName(frames["ignored_findings"]).filter(D.is_allocation(F.col("rule_id")))
    _rows(out, "Allocations", ledger, ["path", "line", "rule_id", "procedure", "operation", "allocation_target", "allocator_source", "certainty"], list(D.ORDER))
    sections = [
        ("Coverage gaps", "coverage_gaps", ["language", "path", "name", "evidence_class", "risk_score"], [F.desc("risk_score"), *_evidence()]),
        ("Coverage", "coverage_counts", ["language", "declarations", "corroborated", "uncovered", "gaps"]),
        ("Security paths", "security_paths", ["source_path", "declaration", "source_id", "source_line", "sink_id", "sink_line", "sanitizers", "explanation"]),
        ("Resource lifetimes", "resource_lifetimes", ["path", "line", "procedure", "operation", "contract_id", "ownership", "lifetime", "status", "explanation"]),
        ("Clones", "clone_groups", ["language", "fingerprint", "occurrences_n", "token_count", "executable_lines"]),
        ("Interop", "interop_pairs", ["symbol", "status", "julia_path", "odin_path", "mismatch"]),
    ]
    if full:
        sections += [
            ("Dependencies", "dependencies", ["source_path", "line", "target", "target_path", "resolution", "kind"]),
            ("Declarations", "declarations", ["path", "line", "qualified_name", "kind", "scope"]),
            ("Imports", "imports", ["path", "line", "target", "name", "kind"]),
            ("References", "references", ["path", "line", "name", "scope"]),
            ("Calls", "calls", ["source_path", "line", "caller", "callee", "kind"]),
            ("Call roots", "call_roots", ["id", "path", "language", "declaration", "category"], ["language", "path", "declaration", "category", "id"]),
            ("Signatures", "interop", ["path", "symbol", "direction", "library", "calling_convention", "parameter_types", "return_types"]),
            ("Test coverage", "test_coverage", ["path", "name", "start_line", "static_reachable", "runtime_covered", "evidence_class", "risk_score", "explanation"], _evidence()),
        ]
    for title, name, columns, *order in sections:
        if name in frames:
            _rows(out, title, frames[name], columns, order[0] if order else columns)


def _evidence() -> list:
    """Order of evidence; lines order as text."""
    return ["language", "path", "name", F.col("start_line").cast("string")]


def _findings(out: TextIO, found: DataFrame) -> None:
    """Findings under a heading for each path."""
    out.write("\n## Findings by file\n")
    measured = found.withColumn("measurement", S.measurement(F.col("measured"), F.col("allowed"))).orderBy("path", *D.ORDER)
    columns = ["line", "column", "rule_id", "response", "message", "measurement"]
    path = None
    for r in measured.select("path", S.markdown_heading(F.col("path")).alias("_heading"), *(S.markdown_cell(F.col(c)).alias(c) for c in columns)).toLocalIterator():
        if path != r["path"]:
            path = r["path"]
            out.write(f"\n### {r['_heading']}\n\n| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n")
        out.write("| " + " | ".join(r[c] for c in columns) + " |\n")


def progress(mode: str):
    """A function that prints milestones to the error stream, or does nothing."""
    if mode == "always" or (mode == "auto" and use_color("auto", sys.stderr)):
        return lambda text: print(text, file=sys.stderr, flush=True)
    return lambda text: None
