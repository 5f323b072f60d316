"""Operators on small fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from factloom.functions import scalars as S
from factloom.operators import aggregates as A
from factloom.operators import findings as D
from factloom.operators import graph as G
from factloom.operators import joins as J
from factloom.operators import lines as L
from factloom.operators import policies as P
from factloom.sources import lcov
from factloom.sources.files import rebased_excludes, source_files


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def cells(text):
    """Rows of a table in text: dots are nulls, digits are numbers, brackets are lists."""
    read_ = lambda c: None if c == "." else int(c) if c.lstrip("-").isdigit() else c[1:-1].split("+") if c.startswith("[") and len(c) > 2 else [] if c == "[]" else c in ("yes",) if c in ("yes", "no") else c
    return [tuple(map(read_, line.split())) for line in text.strip().splitlines()]


FUNCTIONS = cells("""
f.jl julia small 1 3 3 0 2 0 yes
f.jl julia middle 4 8 5 0 4 0 yes
f.jl julia large 9 15 7 0 6 0 yes
f.odin odin middle 1 6 6 0 5 . yes
edge.odin odin edge 1 3 3 0 2 . yes
""")
FUNCTION = "path string, language string, name string, start_line long, end_line long, executable_lines long, parameter_count long, cyclomatic long, cognitive long, documented boolean"
TIERS = {("julia", "lines"): (2, 4, 6), ("odin", "lines"): (3, 5, 7), ("julia", "cyclomatic"): (1, 3, 5), ("odin", "cyclomatic"): (2, 4, 6)}


def test_metric_tiers(spark):
    found = D.metric_findings(spark.createDataFrame(FUNCTIONS, FUNCTION), TIERS).collect()
    assert sorted((r.path, r.subject, r.rule_id.rpartition("-")[2], r.allowed) for r in found) == sorted(cells("f.jl small REPORT 2\nf.jl small REPORT 1\nf.jl middle WARN 4\nf.jl middle WARN 3\nf.jl large FAIL 6\nf.jl large FAIL 5\nf.odin middle WARN 5\nf.odin middle WARN 4"))


def test_repository_statistics(spark):
    files = spark.createDataFrame(cells("a.jl julia 10 8 6 2 2 2\nb.odin odin 20 17 15 2 3 3\nc.md markdown 100 90 90 0 10 0"), "path string, language string, physical_lines long, source_lines long, code_lines long, comment_lines long, blank_lines long, struct_count long")
    functions = spark.createDataFrame([("julia", 4), ("odin", 3)], "language string, cyclomatic long")
    total = A.code_statistics(files, functions).filter("language = 'total'").first()
    assert (total.files, total.functions, total.struct_count, total.physical_lines, total.blank_lines, total.comment_lines, total.code_lines, total.complexity) == (2, 2, 5, 30, 5, 4, 21, 7)
    assert math.isclose(total.density, 1 / 3)
    empty = A.code_statistics(files.limit(0), functions.limit(0)).filter("language = 'total'")
    assert empty.first().density == 0
    estimate = empty.select(*(v.alias(k) for k, v in A.cocomo(F.col("code_lines")).items())).first()
    assert tuple(estimate) == (0, 0, 0, 0)


DECLARATION = "path string, language string, name string, qualified_name string, kind string, scope string, line long, column long"


def test_reachability(spark):
    names = ["main", "helper", "unused"]
    declarations = spark.createDataFrame([("app.jl", "julia", n, f"App.{n}", "function", "App", k, 1) for k, n in enumerate(names)], DECLARATION)
    edges = spark.createDataFrame(cells("julia App.main helper direct\njulia App.helper factory() dynamic"), "language string, caller string, callee string, kind string")
    roots = spark.createDataFrame([("julia", "main")], "language string, declaration string")
    assert rows(G.unreachable(declarations, edges, roots), "qualified_name") == [("App.unused",)]
    assert G.unreachable(declarations, edges, roots.limit(0)).count() == 0
    entries = spark.createDataFrame([("a", "julia", "unused", "production"), ("b", "julia", "removed", "production")], "id string, language string, name string, category string")
    assert rows(J.configured_roots(declarations, entries), "id", "qualified_name") == [("a", "App.unused")]
    assert rows(J.root_drift(declarations, entries), "id") == [("b",)]
    # edges without a caller fire in one closure and never in the other
    open_ = spark.createDataFrame([("julia", None, "unused", "direct")], "language string, caller string, callee string, kind string")
    assert ("unused",) in rows(G.reachable_names(declarations, open_, roots), "name")
    assert ("unused",) not in rows(G.reachable_names(declarations, open_, roots, open_callers=False), "name")


def test_closure_with_cycles(spark):
    edges = spark.createDataFrame([(str(k), str((k + 1) % 14)) for k in range(14)] + [("x", "y")], "source string, target string")
    assert G.closure(spark.createDataFrame([("3",)], "node string"), edges, []).count() == 14


def test_value_edges(spark):
    declarations = spark.createDataFrame([("a.jl", "julia", "f", "f", "function", None, 1, 1), ("a.jl", "julia", "g", "g", "function", None, 5, 1)], DECLARATION)
    references = spark.createDataFrame([("a.jl", "julia", "f", None, 1, 1), ("a.jl", "julia", "f", "g", 6, 3), ("a.jl", "julia", "f", "App", 9, 3), ("a.jl", "julia", "other", "g", 6, 9)], "path string, language string, name string, scope string, line long, column long")
    assert [tuple(r) for r in J.value_edges(declarations, references).select("caller", "callee", "line").orderBy("line").collect()] == [("g", "f", 6), (None, "f", 9)]


def test_lcov(spark):
    text = "SF:src/example.jl\nDA:2,1\nDA:3,0,checksum\nend_of_record\nSF:src/example.jl\nDA:2,2\nend_of_record\nSF:/tmp/external.jl\nDA:1,4\nend_of_record\n"
    frame = spark.createDataFrame([("t", text)], "name string, text string")
    assert rows(lcov.parse(frame, "/repo"), "path", "line", "count") == [("src/example.jl", 2, 3), ("src/example.jl", 3, 0)]
    for bad in ("DA:1,1\n", "SF:a\nSF:b\n", "end_of_record\n", "SF:a\n", "SF:a\nDA:x,1\nend_of_record", "SF:a\nDA:0,1\nend_of_record", "SF:a\nDA:1,-1\nend_of_record"):
        with pytest.raises(lcov.TraceError):
            list(lcov.records(bad))
    a, b = (spark.createDataFrame(x, "path string, line long, count long") for x in ([("p", 2, 1)], [("p", 2, 3), ("p", 4, 0)]))
    assert rows(lcov.merge(a, b), "line", "count") == [(2, 4), (4, 0)]


@pytest.mark.parametrize("static,runtime,label,gap", [(True, True, "corroborated", False), (True, False, "static-only", True), (False, True, "runtime-only", True), (False, False, "uncovered", True), (True, None, "runtime-unavailable", False), (False, None, "runtime-unavailable", True), (None, True, "static-unavailable", False), (None, None, "unavailable", False)])
def test_evidence(spark, static, runtime, label, gap):
    a, b = F.lit(static).cast("boolean"), F.lit(runtime).cast("boolean")
    assert value(spark, S.evidence_class(a, b)) == label
    assert value(spark, S.is_gap(a, b)) == gap


def test_risk(spark):
    assert value(spark, S.risk_score(F.lit(4), F.lit(11), F.lit(True))) == 11
    assert value(spark, S.risk_score(F.lit(4), F.lit(11), F.lit(False))) == 6


CALL = "source_path string, language string, caller string, callee string, kind string, line long, column long"


def test_security_order(spark):
    contract = "id string, language string, declaration string, category string"
    sources, sinks, clean = (spark.createDataFrame([x], contract) for x in (("src", "julia", "readline", "input"), ("snk", "julia", "run", "process"), ("julia-allowlist", "julia", "allow", "sanitizer")))
    paths = lambda calls: J.security_paths(spark.createDataFrame([("a.jl", "julia", "App.f", c, k, n, 1) for c, k, n in calls], CALL), sources, sinks, clean).collect()
    assert paths([("run", "direct", 2), ("readline", "direct", 3)]) == []
    one = paths([("readline", "direct", 2), ("callable", "dynamic", 3), ("run", "direct", 4)])
    assert len(one) == 1 and one[0].sanitizers == [] and "No configured sanitizer" in one[0].explanation
    assert paths([("readline", "direct", 2), ("allow", "direct", 3), ("run", "direct", 4)])[0].sanitizers == ["julia-allowlist"]


def test_lifetimes(spark):
    events = spark.createDataFrame([(1, "temporary", "make", "context.temp_allocator")], "event long, category string, operation string, allocator_source string")
    schema = "id string, ord int, category string, operation string, allocator_source string, ownership string, lifetime string, release_operation string, allows_escape boolean, reason string"
    exact = ("exact", 2, "temporary", "make", "context.temp_allocator", "arena", "frame", None, False, "why")
    broad = ("broad", 1, "temporary", None, None, "arena", "frame", None, False, "why")
    status = lambda c: J.contract_lifetimes(events, spark.createDataFrame(c, schema), ["event"]).first()
    assert (status([]).status, status([exact]).status, status([exact]).contract_id) == ("unresolved", "complete", "exact")
    both = status([exact, broad])
    assert both.status == "ambiguous" and "broad, exact" in both.explanation


def test_clones(spark):
    rows_ = [("julia", "shared-body", 10, 3, "a.jl"), ("julia", "shared-body", 10, 3, "b.jl"), ("odin", "shared-body", 10, 3, "c.odin")]
    bodies = spark.createDataFrame(rows_, "language string, body string, token_count long, executable_lines long, occurrence string")
    groups = A.clone_groups(bodies, 2, 1, 1)
    assert rows(groups, "language", "occurrences_n", "first_occurrence") == [("julia", 2, "a.jl")]
    assert A.clone_groups(bodies, 2, 11, 4).count() == 0
    assert A.clone_members(bodies, groups).count() == 2


def test_interop(spark):
    schema = "path string, language string, symbol string, direction string, library string, calling_convention string, parameter_types array<string>, return_types array<string>, ord long"
    table = cells("""
    a.jl julia differs import . c [i32] [i32] 1
    b.odin odin differs export . c [i64] [i32] 2
    a.jl julia left import . c [] [] 3
    b.odin odin right export . c [] [] 4
    a.jl julia puts import libc c [] [] 5
    b.odin odin differs export . c [i32] [i32] 6
    """)
    got = {(r.symbol, r.status): r.mismatch for r in J.pair_signatures(spark.createDataFrame(table, schema)).collect()}
    assert got == {("differs", "signature-mismatch"): "parameter types i32 != i64", ("left", "missing-odin"): None, ("right", "missing-julia"): None, ("puts", "external"): None, ("differs", "missing-julia"): None}


def test_layers(spark):
    schema = "source_path string, target string, target_path string, resolution string, language string, kind string, line long, column long"
    table = cells("""
    app.jl JSON3 . external julia using 1 1
    app.jl ..Local app.jl repository julia import 2 1
    app.jl .Missing . unresolved julia import 3 1
    lib/math/math.odin ../.. ROOT repository odin import 1 1
    main.odin core:fmt . external odin import 1 1
    main.odin lib/math lib/math repository odin import 2 1
    """)
    table = [tuple("." if c == "ROOT" else c for c in row) for row in table]
    edges = spark.createDataFrame(table, schema)
    owned = J.layer_edges(edges, [(".", "application"), ("lib", "library")])
    allowed = spark.createDataFrame([("application", "library")], "source_layer string, target_layer string")
    assert rows(J.forbidden(owned, allowed), "source_layer", "target_layer") == [("library", "application")]
    cycle = G.dependency_cycles(owned.withColumn("ord", F.struct("source_path", "line"))).collect()
    assert [(r["members"], r["size"], r["evidence"]["source_path"]) for r in cycle] == [(["application", "library"], 2, "lib/math/math.odin")]
    assert rows(J.unresolved_imports(edges), "target") == [(".Missing",)]


def test_julia_resolution(spark):
    modules = spark.createDataFrame([("app.jl", "App", 1, 50, 1), ("app.jl", "App.Local", 10, 20, 2), ("app.jl", "App.Local.Deep", 12, 14, 3)], "path string, name string, start_line long, end_line long, depth long")
    targets = [("App.Local.thing", 2), ("..Local", 15), (".Deep", 15), ("...Local", 13), ("....App", 13), (".Missing", 3), ("JSON3", 3), ("Apples", 3)]
    edges = spark.createDataFrame([(str(k), "app.jl", t, n) for k, (t, n) in enumerate(targets)], "edge string, source_path string, target string, line long")
    got = {r.target: r.resolution for r in J.resolve_julia(edges, modules, "edge").collect()}
    assert got == {"App.Local.thing": "repository", "..Local": "repository", ".Deep": "repository", "...Local": "repository", "....App": "unresolved", ".Missing": "unresolved", "JSON3": "external", "Apples": "external"}


def test_odin_resolution(spark):
    files = spark.createDataFrame([("main.odin",), ("lib/math/math.odin",)], "path string")
    edges = spark.createDataFrame(cells("main.odin lib/math\nlib/math/math.odin ../..\nmain.odin core:fmt\nmain.odin lib/none\nmain.odin ../out"), "source_path string, target string")
    got = {r.target: (r.target_path, r.resolution) for r in J.resolve_odin(edges, files).collect()}
    assert got == {"lib/math": ("lib/math", "repository"), "../..": (".", "repository"), "core:fmt": (None, "external"), "lib/none": (None, "unresolved"), "../out": (None, "unresolved")}


def test_layer_tie(spark):
    paths = spark.createDataFrame([("a/x",), ("b",)], "path string")
    assert rows(J.owning_layer(paths, [(".", "root"), ("a", "letter")]), "path", "layer") == [("a/x", "root"), ("b", "root")]
    assert rows(J.owning_layer(paths, [("a", "letter"), (".", "root")]), "path", "layer") == [("a/x", "letter"), ("b", "root")]


POLICY = "policy_id string, ord int, rule_id string, path string, subject string, operation string, min_matches int, max_matches int, policy_response string, policy_reason string, policy_path string"


def test_naming_policies(spark):
    names = spark.createDataFrame([("a.jl", 1, "Bad"), ("a.jl", 2, "Bad")], "path string, line long, name string")
    found = D.diagnostics(names, rule_id=F.lit("JULIA-NAMING"), response=F.lit("Warn"), path=F.col("path"), line=F.col("line"), column=F.lit(1), subject=F.col("name"), operation=F.lit("function"))
    policy = spark.createDataFrame([("p", 1, "JULIA-NAMING", "a.jl", "Bad", "function", 2, 2, "Report", "ok", "a.jl")], POLICY)
    changed, drift = P.naming_policies(found, policy, ["path", "line"])
    assert rows(changed, "response", "reviewed_policy_id") == [("Report", "p")] * 2 and drift.count() == 0
    _, drift = P.naming_policies(found.filter("line = 1"), policy, ["path", "line"])
    assert drift.first().message.endswith("expected 2-2 matches, found 1.") and drift.first().response == "Fail"
    assert P.scanned(policy, spark.createDataFrame([("b.jl",)], "path string")).count() == 0


def test_allocation_policies_with_wildcards(spark):
    one = spark.range(1)
    found = D.diagnostics(one, rule_id=F.lit("ODIN-ALLOCATION-HEAP"), response=F.lit("Warn"), path=F.lit("a.odin"), line=F.lit(1), column=F.lit(1), procedure=F.lit("p"), operation=F.lit("new"), allocation_target=F.lit("int"))
    schema = POLICY.replace("subject string, operation string", "procedure string, operation string, allocation_target string, allocator_source string, certainty string")
    rule = lambda i, operation: (i, 1, "ODIN-ALLOCATION-HEAP", "a.odin", "p", operation, None, None, None, 1, 1, "Report", "ok", "a.odin")
    changed, drift = P.allocation_policies(found, spark.createDataFrame([rule("any", None)], schema), ["path", "line"])
    assert changed.first().response == "Report" and drift.count() == 0
    changed, drift = P.allocation_policies(found, spark.createDataFrame([rule("any", None), rule("new", "new"), rule("other", "make")], schema), ["path", "line"])
    assert changed.first().response == "Warn"
    assert sorted(r.message for r in drift.collect()) == ["Finding matches multiple reviewed policies: any, new.", "Reviewed allocation policy other expected 1-1 matches, found 0."]


@pytest.mark.parametrize("name,casing,ok", [("_parse_value!", "snake_case", True), ("Base.show", "snake_case", True), ("ccall_ABI", "snake_case", True), ("ParseValue", "snake_case", False), ("start_θ", "snake_case", True), ("ω_0", "snake_case", True), ("penFloorθ", "snake_case", False), ("MAX_Θ", "screaming_snake_case", True), ("_", "snake_case", True), ("__", "snake_case", False), ("Vector2", "ada_case", True), ("Bad_Type", "ada_case", True), ("LIMIT", "camel_or_screaming", True)])
def test_names(spark, name, casing, ok):
    assert value(spark, S.valid_name(F.lit(name), casing, ("Base.show",), ("^ccall_",))) == ok


@pytest.mark.parametrize("name,kind", [("Cint", "i32"), ("Ptr{Cvoid}", "^void"), ("Ptr{ UInt8 }", "^UInt8"), ("Cuchar", "u8"), ("Other", "Other")])
def test_abi(spark, name, kind):
    from factloom.extract.abi import neutral

    assert value(spark, S.abi_type(F.lit(name))) == kind == neutral(name)
    assert value(spark, S.abi_returns(F.lit("Cvoid"))) == []


def test_paths(spark):
    assert value(spark, S.repository_path(F.lit("/repo/src/a.jl"), "/repo")) == "src/a.jl"
    for outside in ("/tmp/a.jl", "../a.jl", "/repository/a.jl"):
        assert value(spark, S.repository_path(F.lit(outside), "/repo")) is None
    assert value(spark, S.excluded(F.lit("src/gen/a.jl"), ["src/gen/"])) and not value(spark, S.excluded(F.lit("src/generated"), ["src/gen"]))
    assert rebased_excludes("/x/src", ["src/julialib", "lib"]) == ["julialib", "lib"]
    assert value(spark, S.terminal_name(F.lit(None).cast("string"))) == "" and value(spark, S.terminal_name(F.lit("A.b.c"))) == "c"


def test_discovery(spark, tmp_path):
    for name in ("a.jl", "b.txt", "docs/c.md", "bin/d.jl", ".git/e.jl", "lib/f.odin", "lib/skip/g.jl"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x\n")
    assert rows(source_files(spark, str(tmp_path), ["lib/skip"]), "path", "language") == [("a.jl", "julia"), ("docs/c.md", "markdown"), ("lib/f.odin", "odin")]
    with pytest.raises(NotADirectoryError):
        source_files(spark, str(tmp_path / "none"))


def test_lines(spark):
    long_ = "x" * 91
    julia = f'# {long_}\nvalue = 1 # {long_}\n#=\n{long_}\n#= nested =#\n{long_}\n=#\ny = "{long_}" * ' + "z" * 20 + "\n\tq = 1\n"
    markdown = f"{long_}\n[a](b) {long_}\n```text\n{long_}\n```\n| a | {long_} |\n|---|---|\n| b | {long_} |\n"
    files = spark.createDataFrame([("a.jl", "julia", julia), ("b.md", "markdown", markdown), ("c.md", "markdown", None)], "path string, language string, text string")
    states = L.line_states(files)
    wide = L.width_findings(states.filter("not exempt"))
    assert rows(wide, "path", "line") == [("a.jl", 2), ("b.md", 1)]
    assert rows(L.tab_findings(states), "path", "line", "column") == [("a.jl", 9, 1)]
    counts = {r.path: r for r in L.line_counts(files, states).collect()}
    assert (counts["a.jl"].physical_lines, counts["a.jl"].comment_lines, counts["a.jl"].blank_lines, counts["a.jl"].code_lines) == (9, 6, 0, 3)
    assert counts["c.md"].physical_lines == 0


def test_display_and_matrix(spark):
    table = [("ODIN-ALLOCATION-HEAP", "Warn", "z.odin", 9), *(("X", "Warn", f"a{k}", k) for k in range(5))]
    found = D.diagnostics(spark.createDataFrame(table, "rule_id string, response string, path string, line long"), rule_id=F.col("rule_id"), response=F.col("response"), path=F.col("path"), line=F.col("line"), column=F.lit(1))
    shown, omitted = D.display(found, 2)
    assert rows(shown, "path") == [("a0",), ("a1",), ("z.odin",)] and omitted.first()[0] == 3
    assert rows(D.severity_matrix(found), "response", "findings", "files", "rules") == [("Fail", 0, 0, 0), ("Report", 0, 0, 0), ("Warn", 6, 6, 2)]
    engine = lambda *s: spark.createDataFrame([(x, x) for x in s], "name string, status string")
    code = lambda e, t: D.exit_code(found, e, t).first()[0]
    assert (code(engine("complete"), "Fail"), code(engine("complete"), "Warn"), code(engine("complete", "failed"), "Fail")) == (0, 1, 2)
    assert D.exit_code(found.limit(0), engine("complete").limit(0), "Report").first()[0] == 0


def test_narrowest_and_bins(spark):
    spans = spark.createDataFrame([("p", "outer", 0, 5000), ("p", "inner", 1000, 1100), ("p", "twin", 1000, 1100), ("q", "other", 0, 10)], "path string, scope string, start long, end long")
    points = spark.createDataFrame([(1, "p", 1050), (2, "p", 4000), (3, "p", 9000), (4, "q", 10), (5, "q", 11)], "id long, path string, at long")
    got = J.narrowest(points, spans, ["path"], "id", "at", "start", "end", ["scope"])
    assert [r.scope for r in got.orderBy("id").collect()] == ["inner", "outer", None, "other", None]


def test_constructor_names(spark):
    found = D.diagnostics(spark.createDataFrame([("Thing",), ("Other",)], "s string"), rule_id=F.lit("JULIA-NAMING"), operation=F.lit("function"), subject=F.col("s"))
    types = spark.createDataFrame([("b.jl", "julia", "Thing", "Thing", "type", None, 1, 1)], DECLARATION)
    assert rows(J.without_constructors(found, types), "subject") == [("Other",)]


def test_components_in_one_task_and_by_colours(spark):
    import random

    from factloom.operators.graph import mutual_components

    rng = random.Random(4)
    edges = [(f"n{rng.randint(0, 60)}", f"n{rng.randint(0, 60)}") for _ in range(75)] + [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "x")]
    reach = {}
    for start in {u for u, _ in edges}:
        seen, todo = set(), [start]
        while todo:
            for u, v in edges:
                if u == todo[-1] and v not in seen:
                    seen.add(v)
                    todo.insert(0, v)
            todo.pop()
        reach[start] = seen
    want = {tuple(sorted({v for v in reach[u] if u in reach.get(v, ())} | {u})) for u in reach}
    table = spark.createDataFrame(edges, "source string, target string")
    for one_task in (1 << 20, 0):
        found = mutual_components(table, one_task).collect()
        assert {tuple(r["members"]) for r in found} == {w for w in want if len(w) > 1} and len(found) == len({r["component"] for r in found})
        assert all(r["component"] == r["members"][0] and r["size"] == len(r["members"]) for r in found)
