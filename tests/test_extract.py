"""Extractors, settings, extensions, sinks and the whole analysis on small sources."""

import io
import json

import pytest
from pyspark.sql import functions as F

from factloom import extensions as X
from factloom.__main__ import main
from factloom.config.rules import REGISTRY, Rule
from factloom.config.settings import Clones, Coverage, EntryPoint, Layer, NamingConvention, ReviewedPolicy, RuleSetting, SecurityContract, Settings, SettingsError, load, validate
from factloom.extract import julia, markdown, odin
from factloom.operators import findings as D
from factloom.plans.analysis import check
from factloom.report import render
from factloom.sources import external
from factloom.sources.files import source_files

JULIA = '''module App
using Base
import Random: rand as pick
const LIMIT = 2
"""A thing."""
struct Item
    value::Int
end
"""Help."""
helper(value) = value > LIMIT ? value : Base.abs(value)
function target(a, b; c=1)
    for x in [y for y in a if y > 0]
        x == b && return helper(x), 1, 2
    end
    a[1] = b
end
function unused()
    return 1
end
end
'''


def test_julia_facts():
    f = julia.File("app.jl", JULIA)
    assert f.error is None and f.structs == 1
    assert [(d["qualified_name"], d["kind"]) for d in f.facts["declarations"]] == [("App", "module"), ("App.LIMIT", "constant"), ("App.Item", "type"), ("App.helper", "function"), ("App.target", "function"), ("App.unused", "function")]
    assert [(c["caller"], c["callee"], c["kind"]) for c in f.facts["calls"] if c["callee"].isidentifier() or "." in c["callee"]] == [("App.helper", "Base.abs", "qualified"), ("App.target", "helper", "direct")]
    assert [(m["name"], m["cyclomatic"], m["parameter_count"], m["documented"]) for m in f.facts["functions"]] == [("helper", 2, 1, True), ("target", 5, 2, False), ("unused", 1, 0, False)]
    assert [(t["name"], t["arity"]) for t in f.facts["tuples"]] == [("target", 3)]
    assert [b["rule"] for b in f.facts["behavior"]] == ["JULIA-UNSIGNALED-ARGUMENT-MUTATION"]
    assert f.doc_lines == {5, 9}


@pytest.mark.parametrize("source", ["function f(", "end", 'x = "open', "if x", "(]", "#= open"])
def test_julia_syntax_errors(source):
    f = julia.File("a.jl", source)
    assert f.error and not any(f.facts.values())


def test_julia_globals_and_parens():
    f = julia.File("a.jl", "a = 1\nb, _ = 2, 3\nconst c = 4\nf(x) = x\nglobal d = 5\nlocal e = 6\nstruct S end\ng(\n  x,\n) = x\nh(x\n) = x\nk()\n")
    assert [g["name"] for g in f.facts["globals"]] == ["a", "b", "d"]
    assert [o["name"] for o in f.facts["order"]] == ["S"]
    assert [p["line"] for p in f.facts["parens"]] == [10, 12]


ODIN = """package fixture
import heap "core:mem/heap"
import "core:fmt"
import math "../math"

VALUE :: 1
STATE := 2

// Run it.
run :: proc(item: int, a, b: string) -> (int, bool) {
    local := item
    if item > 1 && local > 2 {
        for x in 0..<3 { fmt.println(x) }
    }
    inner :: proc() { switch VALUE { case 1: run(1, "a", "b"); case: } }
    return local, true
}
Later :: struct { field: int, other, more: string, }
@(export, link_name="bridge")
add :: proc "c" (a, b: i32, p: rawptr) -> i32 { return a + b }
puts :: proc "c" (text: cstring) ---
"""


def test_odin_facts():
    f = odin.File("a.odin", ODIN)
    assert not f.errors and f.structs == 1
    names = [(d["qualified_name"], d["kind"]) for d in f.facts["declarations"]]
    assert ("run", "procedure") in names and ("run.item", "parameter") in names and ("run.local", "variable") in names and ("Later", "type") in names
    assert [(m["name"], m["cyclomatic"], m["parameter_count"]) for m in f.facts["functions"]][:1] == [("run", 3, 3)]
    assert next(m for m in f.facts["functions"] if m["name"] == "inner")["cyclomatic"] == 3
    assert {(c["caller"], c["callee"]) for c in f.facts["calls"]} == {("run", "fmt.println"), ("inner", "run")}
    assert [(i["name"], i["target"]) for i in f.facts["imports"]] == [("heap", "core:mem/heap"), ("fmt", "core:fmt"), ("math", "../math")]
    assert [g["name"] for g in f.facts["globals"]] == ["STATE"]
    assert [(i["symbol"], i["direction"], i["parameter_types"], i["return_types"]) for i in f.facts["interop"]] == [("bridge", "export", ["i32", "i32", "^void"], ["i32"]), ("puts", "import", ["cstring"], [])]
    assert [(t["name"], t["arity"]) for t in f.facts["tuples"] if t["arity"] > 1] == [("run", 2)]
    assert next(d for d in f.facts["docs"] if d["name"] == "run")["doc"] == "// Run it."


def test_odin_errors():
    assert odin.File("a.odin", "f :: proc( {\n}").errors == 1


MARKDOWN = """# Title
### Jump
Setext
---
```
code # not a heading
```
```julia
x
```
[a](missing.md) [b](#anchor) [c](https://x.y) [d](mailto:z) ![](img.png)
![alt](app.jl?raw)
"""


def test_markdown_facts():
    f = markdown.File("a.md", MARKDOWN)
    assert [(h["line"], h["level"]) for h in f.headings] == [(1, 1), (2, 3), (3, 2)]
    assert [x["line"] for x in f.fences] == [5]
    assert [(x["target"], x["relative"], x["image"], x["label"]) for x in f.links] == [("missing.md", True, False, "a"), ("", False, False, "b"), ("https://x.y", False, False, "c"), ("mailto:z", False, False, "d"), ("img.png", True, True, ""), ("app.jl", True, True, "alt")]


def test_settings():
    assert validate(Settings()) and len(REGISTRY) == 69

    def broken(**changes):
        with pytest.raises(SettingsError):
            validate(Settings(**changes))

    broken(threshold="Ignore")
    broken(rules=Settings().rules[1:])
    broken(rules=[*Settings().rules, RuleSetting("NEW")])
    broken(rules=[RuleSetting(r.rule_id, False if r.rule_id == "JULIA-SYNTAX" else r.enabled, r.response) for r in Settings().rules])
    broken(conventions=[NamingConvention("julia", "function", "loud")])
    broken(conventions=[NamingConvention("odin", "procedure", "snake_case", allow_constructor_names=True)])
    broken(documentation_pattern=".*")
    broken(layers=[Layer("a", ["x"]), Layer("b", ["x"])])
    broken(layers=[Layer("a", ["x"])], allowed_dependencies=[["a", "b"]])
    broken(metric_policies=[ReviewedPolicy("p", "../x", "Warn", "r")])
    broken(clone_policies=[ReviewedPolicy("p", ".", "Ignore", "r", subject="0" * 64)])
    broken(entry_points=[EntryPoint("e", "perl", "main")])
    broken(profile="none")


def test_settings_file(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"threshold": "Warn", "rules": [{"rule_id": "COMMON-LINE-90", "enabled": False}], "widths": {"warning": 80, "discouraged": 90, "hard": 100}, "profiles": [{"name": "fast", "excludes": ["gen"]}]}))
    s = load(str(path), "fast")
    assert not s.rule("COMMON-LINE-90").enabled and s.widths.hard == 100 and s.all_excludes() == ["gen"]
    path.write_text(json.dumps({"colour": 1}))
    with pytest.raises(SettingsError):
        load(str(path))


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "repo"
    for name, text in {"app.jl": JULIA, "test/app_test.jl": "test_entry() = helper(1)\n", "lib/a.odin": ODIN, "README.md": MARKDOWN, "bad.jl": "function f("}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "trace.info").write_text("SF:app.jl\nDA:10,1\nDA:12,0\nend_of_record\n")
    return root


class Counter(X.Extension):
    extension_id = "counter"
    rules = (Rule("EXT-COUNT", "common", "stable", "mature", "Warn"),)

    def analyze(self, context, prior):
        rows = D.diagnostics(context["files"].filter("path = 'README.md'"), rule_id=F.lit("EXT-COUNT"), path=F.col("path"), line=F.lit(1), column=F.lit(1), message=F.lit("counted"))
        return X.ExtensionResult("counter", self.phases[0], diagnostics=rows, artifacts={"files": 1})


class Broken(X.Extension):
    extension_id = "broken"
    dependencies = ("counter",)

    def analyze(self, context, prior):
        assert prior["counter"].artifacts == {"files": 1}
        raise RuntimeError("no")


def test_analysis(spark, tree):
    s = Settings(clones=Clones(True, 3, 1, 2), coverage=Coverage(True, [str(tree / "trace.info")]), security_enabled=True, sources=[SecurityContract("s", "julia", "helper", "input")], sinks=[SecurityContract("k", "julia", "abs", "output")], lifetime_enabled=True, layers=[Layer("app", ["."]), Layer("lib", ["lib"])], entry_points=[EntryPoint("gone", "julia", "gone")], metric_policies=[ReviewedPolicy("stale", "app.jl", "Report", "old", "JULIA-CYCLOMATIC-FAIL", "target")])
    report = check(spark, str(tree), s, [Broken(), Counter()])
    found = {(r.rule_id, r.path, r.line) for r in report.frames["diagnostics"].collect()}
    for wanted in [("JULIA-UNREACHABLE-FUNCTION", "app.jl", 17), ("JULIA-RETURN-TUPLE", "app.jl", 13), ("JULIA-SYNTAX", "bad.jl", 1), ("MARKDOWN-HEADING-LEVELS", "README.md", 2), ("MARKDOWN-CODE-FENCE-LANGUAGE", "README.md", 5), ("MARKDOWN-RELATIVE-LINK", "README.md", 11), ("MARKDOWN-IMAGE-ALT-TEXT", "README.md", 11), ("JULIA-DOC-MISSING", "app.jl", 11), ("ODIN-NONCONST-GLOBAL", "lib/a.odin", 7), ("ODIN-DECLARATION-ORDER", "lib/a.odin", 18), ("ODIN-UNUSED-IMPORT", "lib/a.odin", 2), ("CALL-ROOT-POLICY-DRIFT", ".", 1), ("FUNCTION-METRIC-POLICY-DRIFT", "app.jl", 1), ("EXT-COUNT", "README.md", 1), ("ARCHITECTURE-UNRESOLVED-INTERNAL-IMPORT", "lib/a.odin", 4)]:
        assert wanted in found, wanted
    assert ("MARKDOWN-RELATIVE-LINK", "README.md", 12) not in found
    assert report.exit_code == 2 and {r.extension_id: r.status for r in report.extensions} == {"counter": "complete", "broken": "failed"}
    evidence = {r.name: r.evidence_class for r in report.frames["test_coverage"].filter("language = 'julia'").collect()}
    assert evidence["helper"] == "corroborated" and evidence["target"] == "uncovered" and evidence["unused"] == "runtime-unavailable"
    files = {r.path: r for r in report.frames["files"].collect()}
    assert not files["bad.jl"].parsed and files["app.jl"].function_count == 3
    text, markdown_, raw = io.StringIO(), io.StringIO(), io.StringIO()
    render.write_text(report, text, s, "never")
    render.write_markdown(report, markdown_, s, True)
    render.write_json(report, raw)
    assert "TOOL FAILURES" in text.getvalue() and "\x1b" not in text.getvalue() and text.getvalue().endswith("exit 2\n")
    assert "## Functions" in markdown_.getvalue() and "| within thresholds |" in markdown_.getvalue()
    section = lambda title: [[c.strip() for c in row.split("|")[1:-1]] for row in markdown_.getvalue().split(f"\n## {title}\n")[1].split("\n## ")[0].splitlines() if row.startswith("| ")]
    assert [r[0] for r in section("COCOMO")] == [r[0] for r in section("LOCOMO")] == ["language", "odin", "julia", "total"]
    assert ["broken", "failed", "RuntimeError: no"] in section("Engines") and ["markdown", "1"] in section("Languages")
    risks = [int(r[-1]) for r in section("Coverage gaps")[1:]]
    assert risks and risks == sorted(risks, reverse=True)
    headings = [row[4:] for row in markdown_.getvalue().split("\n## Findings by file\n")[1].split("\n## ")[0].splitlines() if row.startswith("### ")]
    assert headings == sorted({p.replace("`", "'") for _, p, _ in found}) and len(section("Findings by file")) == len(headings) + report.frames["diagnostics"].count()
    roots = [tuple(r[k] for k in (2, 1, 3, 4)) for r in section("Call roots")[1:]]
    assert roots == sorted(roots)
    document = json.loads(raw.getvalue())
    assert document["exit_code"] == 2 and {d["response"] for d in document["diagnostics"]} <= {"report", "warn", "fail"}


def test_extension_contract():
    cycle = [type(n, (Broken,), {"extension_id": n, "dependencies": (d,)})() for n, d in (("a", "b"), ("b", "a"))]
    with pytest.raises(X.ExtensionError, match="a, b"):
        X.ordered(cycle)
    assert [e.extension_id for e in X.ordered([Broken(), Counter()])] == ["counter", "broken"]
    for change in ({"api_version": "0"}, {"dependencies": ("x",)}, {"phases": ("later",)}, {"rules": (Rule("JULIA-SYNTAX", "julia", "stable", "mature", "Fail"),)}):
        with pytest.raises(X.ExtensionError):
            X.validated([type("E", (Counter,), change)()])


def test_command_line(spark, tree, tmp_path, capsys):
    assert main(["check"]) == 2
    assert main(["check", str(tree), "--settings", str(tmp_path / "none.json")]) == 2


def test_command_line_outputs(spark, tree, tmp_path, capsys):
    code = main(["check", str(tree), "--format", "json", "--progress", "never", "--tables", str(tmp_path / "tables"), "--report", str(tmp_path / "short.md"), "--full-report", str(tmp_path / "full.md")])
    document = json.loads(capsys.readouterr().out)
    assert code == document["exit_code"] == 1
    for name in ("diagnostics", "files", "engines"):
        rows = spark.read.json(str(tmp_path / "tables" / name)).count()
        assert rows == len(document[name]) > 0
    short, full = (tmp_path / "short.md").read_text(), (tmp_path / "full.md").read_text()
    assert full.startswith(short) and "\n## Call roots\n" in full and "\n## Call roots\n" not in short


def test_scan_opens_kept_files_only(spark, tmp_path):
    """Pruned and excluded files are never opened; names with blanks, percents and non-ASCII letters are."""
    for name in ("a b%20c.jl", "é.odin", "bin/x.jl", "lib/out/y.jl", "lib/.build/z.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"# {name}")
    for name in ("bin/x.jl", "lib/out/y.jl"):
        (tmp_path / name).write_bytes(b"\xff\xfe")
    got = {r["path"]: (r["language"], r["text"]) for r in source_files(spark, str(tmp_path), ["lib/out"]).collect()}
    assert got == {"a b%20c.jl": ("julia", "# a b%20c.jl"), "é.odin": ("odin", "# é.odin")}


def test_external_facts(spark, tmp_path):
    native = {"version": "3.10.0", "files": [{"path": "a.odin", "parsed": False, "errors": 2, "struct_count": 0, "findings": [{"rule_id": "ODIN-ALLOCATION-HEAP", "line": 1, "column": 2, "procedure": "", "operation": "new"}], "calls": [{"caller": "", "callee": "f", "kind": "direct", "line": 1, "column": 1}]}]}
    (tmp_path / "n.json").write_text(json.dumps(native))
    files = external.native_summaries(spark, str(tmp_path / "n.json"))
    assert external.native_calls(files).first().caller is None
    assert external.native_allocations(files).first().procedure is None
    assert external.syntax_findings(files).first().measured == 2
    (tmp_path / "n2.json").write_text(json.dumps({**native, "version": "1"}))
    with pytest.raises(Exception, match="native facts have version 1"):
        external.native_summaries(spark, str(tmp_path / "n2.json")).count()
    (tmp_path / "j.json").write_text("\n".join(json.dumps({"path": "a.jl", "line": 1, "column": 1, "message": "m", "ord": k}) for k in range(3)))
    assert external.inference_findings(spark, str(tmp_path / "j.json")).count() == 1
    (tmp_path / "b.json").write_text(json.dumps({"id": "x", "input": "a", "exit_code": 3}) + "\n" + json.dumps({"id": "y", "input": "b", "exit_code": 0}))
    assert [(r.subject, r.measured) for r in external.build_findings(external.read_builds(spark, str(tmp_path / "b.json"))).collect()] == [("x", 3)]


def test_check_reads_external_facts(spark, tree, tmp_path):
    native = {"version": "3.10.0", "files": [{"path": "lib/a.odin", "parsed": True, "errors": 0, "findings": [{"rule_id": "ODIN-ALLOCATION-HEAP", "line": 7, "column": 2, "operation": "native_new"}], "calls": [{"caller": "run", "callee": "native_callee", "kind": "direct", "line": 8, "column": 1}]}]}
    (tmp_path / "n.json").write_text(json.dumps(native))
    (tmp_path / "j.json").write_text(json.dumps({"path": "app.jl", "line": 3, "column": 1, "message": "no method", "ord": 1}))
    (tmp_path / "b.json").write_text(json.dumps({"id": "x", "input": "lib", "exit_code": 3}))
    s = Settings()
    s.external.native, s.external.inference, s.external.builds = [str(tmp_path / "n.json")], [str(tmp_path / "j.json")], [str(tmp_path / "b.json"), str(tmp_path / "none.json")]
    lost = check(spark, str(tree), s)
    assert {r["name"]: r["status"] for r in lost.frames["engines"].collect()}["odin-build"] == "failed" and lost.exit_code == 2
    s.external.builds.pop()
    report = check(spark, str(tree), s)
    engines = {r["name"]: r["status"] for r in report.frames["engines"].collect()}
    assert engines["jet"] == engines["odin-build"] == "complete" and report.exit_code == 1
    found = [(r["rule_id"], r["path"], r["operation"]) for r in report.frames["diagnostics"].filter("rule_id in ('JULIA-JET-POSSIBLE-ERROR', 'ODIN-BUILD-FAILED') or rule_id like 'ODIN-ALLOCATION-%'").collect()]
    assert sorted(found, key=str) == [("JULIA-JET-POSSIBLE-ERROR", "app.jl", None), ("ODIN-ALLOCATION-HEAP", "lib/a.odin", "native_new"), ("ODIN-BUILD-FAILED", "lib", None)]
    assert [r["callee"] for r in report.frames["calls"].filter("language = 'odin'").collect()] == ["native_callee"]


def test_ledger_holds_ignored_allocations(spark, tree, tmp_path):
    native = {"version": "3.10.0", "files": [{"path": "lib/a.odin", "parsed": True, "errors": 0, "calls": [], "findings": [{"rule_id": "ODIN-ALLOCATION-HEAP", "line": k, "column": 2, "operation": "new"} for k in (7, 9)]}]}
    (tmp_path / "n.json").write_text(json.dumps(native))
    s = Settings()
    s.external.native = [str(tmp_path / "n.json")]
    for r in s.rules:
        if r.rule_id.startswith("ODIN-ALLOCATION-") and not REGISTRY[r.rule_id].immutable:
            r.response = "Ignore"
    report = check(spark, str(tree), s)
    ignored = report.frames["ignored_findings"].filter("rule_id like 'ODIN-ALLOCATION-%'").count()
    assert ignored == 2 and not report.frames["diagnostics"].filter("rule_id like 'ODIN-ALLOCATION-%'").count()
    out = io.StringIO()
    render.write_markdown(report, out, s)
    ledger = out.getvalue().split("## Allocations")[1].split("\n## ")[0]
    assert ledger.count("| ODIN-ALLOCATION-") == ignored
