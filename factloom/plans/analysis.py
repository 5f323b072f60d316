"""The whole analysis of a source tree: facts, derived relations, findings, policies, summaries."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import extensions as X
from factloom.config.rules import REGISTRY, engine_of
from factloom.config.settings import Settings, validate
from factloom.deploy import ship
from factloom.extract.facts import extract
from factloom.functions import scalars as S
from factloom.operators import aggregates as A
from factloom.operators import findings as D
from factloom.operators import graph as G
from factloom.operators import joins as J
from factloom.operators import lines as L
from factloom.operators import policies as P
from factloom.sources import external, lcov
from factloom.sources.files import source_files
from factloom.storage import written


@dataclass
class Report:
    """Relations of an analysis by name, and its exit code."""

    root: str
    frames: dict[str, DataFrame] = field(default_factory=dict)
    exit_code: int = 0
    extensions: list[X.ExtensionResult] = field(default_factory=list)


def _table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _at(df: DataFrame, rule, message, source: str, **more) -> DataFrame:
    columns = {"path": F.col("path"), "line": F.col("line"), "column": F.col("column") if "column" in df.columns else F.lit(1)}
    return D.diagnostics(df, rule_id=rule, message=message, source=F.lit(source), **{**columns, **more})


def naming_findings(names: DataFrame, settings: Settings) -> DataFrame:
    """Names against the convention of their language and kind."""
    ok = F.lit(True)
    for c in settings.conventions:
        here = (F.col("language") == c.language) & (F.col("kind") == c.kind)
        ok = F.when(here, S.valid_name(F.col("name"), c.casing, tuple(c.ignored_names), tuple(c.ignored_patterns))).otherwise(ok)
    rule = F.concat(F.upper("language"), F.lit("-NAMING"))
    text = F.concat(F.initcap(F.replace("kind", F.lit("_"), F.lit(" "))), F.lit(" name `"), F.col("name"), F.lit("` does not follow its convention."))
    return _at(names.filter(~ok), rule, text, "naming", subject=F.col("name"), operation=F.col("kind"))


def file_findings(files: DataFrame, facts: dict[str, DataFrame], lines: DataFrame, settings: Settings) -> DataFrame:
    """Findings that need one file only."""
    s = settings
    widths = (s.widths.warning, s.widths.discouraged, s.widths.hard)
    julia, odin = F.col("language") == "julia", F.col("language") == "odin"
    upper = F.upper("language")
    named = lambda what: F.concat(F.lit(f"{what} `"), F.col("name"), F.lit("`"))
    tuples = facts["tuples"].filter((julia & (F.col("arity") > s.julia_tuple)) | (odin & (F.col("arity") > s.odin_tuple)))
    functions = facts["functions"].withColumn("line", F.col("start_line"))
    many = functions.withColumn("tier", F.when(julia & (F.col("parameter_count") > s.julia_parameters), "FAIL").when(odin & (F.col("parameter_count") > s.odin_parameters_fail), "FAIL").when(odin & (F.col("parameter_count") > s.odin_parameters_warn), "WARN")).filter("tier is not null")
    limit = F.when(julia, s.julia_parameters).when(F.col("tier") == "FAIL", s.odin_parameters_fail).otherwise(s.odin_parameters_warn)
    docs = facts["docs"].filter("name <> '<anonymous>'")
    good = docs.filter(F.coalesce(F.col("doc").rlike(s.documentation_pattern), F.lit(False))).select("path", "name").distinct()
    undocumented = D.first_of_each(docs.join(good, ["path", "name"], "left_anti"), ["path", "name"], ["line"])
    headings = facts["headings"]
    ones = headings.groupBy("path").agg(F.count_if(F.col("level") == 1).alias("n"), F.min("line").alias("line"))
    single = files.filter("language = 'markdown'").select("path").join(ones, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("line", F.lit(1)).alias("line")).filter("n <> 1")
    known = files.select("path").unionByName(J.directories(files).select(F.col("directory").alias("path"))).distinct().withColumnRenamed("path", "place")
    folder = F.regexp_replace("path", r"(^|/)[^/]*$", "")
    links = facts["links"].filter("relative and target <> ''").withColumn("place", J.normalized(F.concat_ws("/", folder, F.col("target"))))
    broken = links.filter("place is null").unionByName(links.filter("place is not null").join(known, "place", "left_anti").select(*links.columns))
    parts = [
        L.width_findings(lines.filter("not exempt"), widths),
        L.tab_findings(lines),
        _at(facts["syntax"].withColumn("line", F.lit(1)), F.concat(upper, F.lit("-SYNTAX")), F.concat(F.lit("Source could not be parsed: "), F.col("message"), F.lit(".")), "syntax", measured=F.col("errors"), allowed=F.lit(0)),
        _at(facts["parens"], F.concat(upper, F.lit("-CLOSING-PAREN-PLACEMENT")), F.lit("A closing parenthesis must share the line of the last argument."), "syntax"),
        _at(facts["behavior"], F.col("rule"), F.concat(F.lit("Behaviour rule: "), F.col("rule"), F.lit(".")), "julia-syntax", subject=F.col("subject")),
        _at(facts["order"], F.concat(upper, F.lit("-DECLARATION-ORDER")), F.concat(named("Declaration"), F.lit(" stands behind a function.")), "syntax", subject=F.col("name")),
        _at(facts["globals"], F.concat(upper, F.lit("-NONCONST-GLOBAL")), F.concat(named("Global"), F.lit(" is mutable.")), "syntax", subject=F.col("name"), operation=F.lit("global")),
        _at(tuples, F.concat(upper, F.lit("-RETURN-TUPLE")), F.concat(named("Callable"), F.lit(" returns too many values.")), "syntax", subject=F.col("name"), measured=F.col("arity"), allowed=F.when(julia, s.julia_tuple).otherwise(s.odin_tuple)),
        _at(many, F.concat(upper, F.lit("-PARAMETERS-"), F.col("tier")), F.concat(named("Callable"), F.lit(" has too many positional parameters.")), "syntax", subject=F.col("name"), measured=F.col("parameter_count"), allowed=limit),
        _at(undocumented, F.concat(upper, F.lit("-DOC-MISSING")), F.concat(named("Callable"), F.lit(" lacks documentation.")), "syntax", subject=F.col("name")),
        _at(single, F.lit("MARKDOWN-SINGLE-H1"), F.lit("A document needs exactly one first-level heading."), "markdown", measured=F.col("n"), allowed=F.lit(1)),
        _at(D.jumps(headings, ["path"], ["ord"], "level"), F.lit("MARKDOWN-HEADING-LEVELS"), F.lit("A heading skips a level."), "markdown", measured=F.col("level"), allowed=F.col("previous") + 1),
        _at(facts["fences"], F.lit("MARKDOWN-CODE-FENCE-LANGUAGE"), F.lit("A code fence names no language."), "markdown"),
        _at(broken, F.lit("MARKDOWN-RELATIVE-LINK"), F.concat(F.lit("Link target `"), F.col("destination"), F.lit("` does not exist.")), "markdown", subject=F.col("destination")),
        _at(facts["links"].filter("image and trim(label) = ''"), F.lit("MARKDOWN-IMAGE-ALT-TEXT"), F.lit("An image has no alternative text."), "markdown"),
        naming_findings(facts["names"], s),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _policy_table(spark: SparkSession, policies: list, files: DataFrame | None) -> DataFrame:
    schema = "policy_id string, ord int, rule_id string, path string, subject string, operation string, procedure string, allocation_target string, allocator_source string, certainty string, min_matches int, max_matches int, policy_response string, policy_reason string, policy_path string"
    rows = [(p.id, k, p.rule_id, p.path, p.subject, p.operation, p.procedure, p.allocation_target, p.allocator_source, p.certainty, p.min_matches, p.max_matches, p.response, p.reason, p.path or ".") for k, p in enumerate(policies)]
    table = _table(spark, rows, schema)
    return table if files is None else P.scanned(table, files).select(*table.columns)


def check(spark: SparkSession, root: str, settings: Settings | None = None, extensions: list[X.Extension] | None = None, files: DataFrame | None = None) -> Report:
    """Analyse a tree (or a given ``(path, language, text)`` table) and return its report."""
    ship(spark)
    extensions = extensions or []
    owned = X.validated(extensions)
    s = settings or Settings()
    configured = {r.rule_id for r in s.rules}
    from factloom.config.settings import RuleSetting

    s.rules += [RuleSetting(r.rule_id, True, r.response) for r in owned.values() if r.rule_id not in configured]
    validate(s, owned)
    report = Report(root)
    frames = report.frames
    files = written(files if files is not None else source_files(spark, root, s.all_excludes()), "sources")
    results = X.run_phase(extensions, X.PHASES[0], {"files": files}, [])
    facts = extract(files)
    lines = written(L.line_states(files), "lines")
    rules = _table(spark, [(r.rule_id, {**REGISTRY, **owned}[r.rule_id].language, engine_of({**REGISTRY, **owned}[r.rule_id]), r.response, r.enabled) for r in s.rules], "rule_id string, language string, engine string, response string, enabled boolean")
    engines: list[tuple[str, str]] = [("common", "complete"), ("julia", "complete"), ("odin", "complete"), ("markdown", "complete")]

    facts, outside, statuses = external_facts(spark, facts, s)
    engines += statuses
    found = [file_findings(files, facts, lines, s), *outside]
    unused = J.unused_imports(facts["imports"], facts["references"])
    found.append(_at(unused, F.concat(F.upper("language"), F.lit("-UNUSED-IMPORT")), F.concat(F.lit("Imported binding `"), F.col("name"), F.lit("` is not referenced in this file.")), "unused-imports", subject=F.col("name"), certainty=F.lit("definite")))

    frames["interop_pairs"] = J.pair_signatures(facts["interop"].withColumn("ord", F.struct("path", "line", "column")))
    edges = facts["dependencies"].withColumnRenamed("path", "source_path").withColumns({"target_path": F.lit(None).cast("string"), "resolution": F.lit("unresolved"), "edge": F.concat_ws(":", "source_path", "line", "column", "target")})
    julia = J.resolve_julia(edges.filter("language = 'julia'"), facts["modules"], "edge")
    odin = J.resolve_odin(edges.filter("language = 'odin'"), files)
    dependencies = written(julia.unionByName(odin.select(*julia.columns)), "dependencies")
    frames["dependencies"] = dependencies
    if s.layers:
        prefixes = [(p, layer.name) for layer in s.layers for p in layer.paths]
        owned_edges = written(J.layer_edges(dependencies, prefixes).withColumn("path", F.col("source_path")), "layers")
        allowed = _table(spark, [tuple(p) for p in s.allowed_dependencies], "source_layer string, target_layer string")
        arrow = F.concat(F.col("source_layer"), F.lit("->"), F.col("target_layer"))
        found.append(_at(J.forbidden(owned_edges, allowed), F.lit("ARCHITECTURE-FORBIDDEN-DEPENDENCY"), F.concat(F.lit("Architecture layer `"), F.col("source_layer"), F.lit("` may not depend on `"), F.col("target_layer"), F.lit("` through `"), F.col("target"), F.lit("`.")), "architecture", subject=arrow))
        cycles = G.dependency_cycles(owned_edges.withColumn("ord", F.struct("source_path", "line", "column")))
        rows = cycles.select("size", F.array_join("members", ", ").alias("members"), F.col("evidence.source_path").alias("path"), F.col("evidence.line").alias("line"), F.col("evidence.column").alias("column"))
        found.append(_at(rows, F.lit("ARCHITECTURE-DEPENDENCY-CYCLE"), F.concat(F.lit("Dependency cycle includes layers: "), F.col("members"), F.lit(".")), "architecture", measured=F.col("size")))
        lost = J.unresolved_imports(dependencies).withColumn("path", F.col("source_path"))
        found.append(_at(lost, F.lit("ARCHITECTURE-UNRESOLVED-INTERNAL-IMPORT"), F.concat(F.lit("Internal "), F.col("language"), F.lit(" import `"), F.col("target"), F.lit("` could not be resolved.")), "architecture", subject=F.col("target")))
    engines.append(("architecture", "complete" if s.layers else "not-applicable"))

    entries = _table(spark, [(e.id, e.language, e.name, e.category) for e in s.entry_points], "id string, language string, name string, category string")
    none = _table(spark, [], "id string, path string, language string, declaration string, category string")
    declarations, calls = facts["declarations"], facts["calls"].withColumnRenamed("path", "source_path")
    roots = written(G.call_roots(declarations, facts["interop"], J.configured_roots(declarations, entries), none), "roots")
    frames["call_roots"] = roots
    every_edge = written(calls.select("source_path", "language", "caller", "callee", "kind", "line", "column").unionByName(J.value_edges(declarations, facts["references"])), "edges")
    dead = G.unreachable(declarations, every_edge, roots)
    kind = F.when(F.col("language") == "julia", "function").otherwise("procedure")
    found.append(_at(dead, F.concat(F.upper("language"), F.lit("-UNREACHABLE-"), F.upper(kind)), F.concat(F.initcap("language"), F.lit(" "), kind, F.lit(" `"), F.col("qualified_name"), F.lit("` is not reachable from a configured root.")), "call-graph", subject=F.col("qualified_name")))
    dynamic = calls.filter("kind = 'dynamic'").withColumn("path", F.col("source_path"))
    found.append(_at(dynamic, F.lit("CALL-GRAPH-UNRESOLVED-EDGE"), F.concat(F.lit("Dynamic call `"), F.col("callee"), F.lit("` could not be resolved.")), "call-graph", subject=F.col("callee")))
    drifted = J.root_drift(declarations, entries).withColumns({"path": F.lit("."), "line": F.lit(1)})
    found.append(_at(drifted, F.lit("CALL-ROOT-POLICY-DRIFT"), F.concat(F.lit("Call root entry point `"), F.col("id"), F.lit("` matches no declared "), F.col("language"), F.lit(" callable named `"), F.col("name"), F.lit("`.")), "call-graph", subject=F.col("id")))
    engines.append(("call-graph", "complete"))

    if s.clones.enabled:
        bodies = facts["clones"].filter(~S.excluded(F.col("path"), s.clones.excludes)).withColumn("occurrence", F.struct("path", "start_line", "end_line", "name"))
        groups = written(A.clone_groups(bodies, s.clones.min_occurrences, s.clones.min_tokens, s.clones.min_lines), "clones")
        frames["clone_groups"] = groups
        rows = groups.select("*", F.col("first_occurrence.path").alias("path"), F.col("first_occurrence.start_line").alias("line"))
        found.append(_at(rows, F.concat(F.upper("language"), F.lit("-DUPLICATE-CODE")), F.concat(F.lit("Exact implementation clone appears "), F.col("occurrences_n").cast("string"), F.lit(" times.")), "duplicate-code", subject=F.col("fingerprint"), measured=F.col("occurrences_n"), certainty=F.lit("definite")))
    engines.append(("duplicate-code", "complete" if s.clones.enabled else "not-applicable"))

    patterns = _table(spark, list(s.allocator_patterns.items()), "allocator_source string, category string")
    allocations = written(J.allocation_rules(facts["allocations"], patterns), "allocations")
    found.append(_at(allocations, F.col("rule_id"), F.concat(F.lit("Allocation by `"), F.col("operation"), F.lit("`.")), "odin-ast", **{c: F.col(c) for c in ("operation", "procedure", "allocation_target", "allocator_source", "certainty")}))
    if s.lifetime_enabled:
        events = allocations.withColumns({"category": F.lower(F.replace(F.replace("rule_id", F.lit("ODIN-ALLOCATION-"), F.lit("")), F.lit("-"), F.lit("_"))), "event": F.concat_ws(":", "path", "line", "column")})
        contracts = _table(spark, [(c.id, k, c.category, c.operation, c.allocator_source, c.ownership, c.lifetime, c.release_operation, c.allows_escape, c.reason) for k, c in enumerate(s.contracts)], "id string, ord int, category string, operation string, allocator_source string, ownership string, lifetime string, release_operation string, allows_escape boolean, reason string")
        frames["resource_lifetimes"] = J.contract_lifetimes(events, contracts, ["event"])
    if s.security_enabled:
        table = lambda rows: _table(spark, [(c.id, c.language, c.declaration, c.category) for c in rows], "id string, language string, declaration string, category string")
        paths = written(J.security_paths(calls, table(s.sources), table(s.sinks), table(s.sanitizers)), "paths")
        frames["security_paths"] = paths
        rows = paths.withColumns({"path": F.col("source_path"), "line": F.col("sink_line")})
        found.append(_at(rows, F.lit("SECURITY-UNSAFE-BOUNDARY"), F.col("explanation"), "security-boundary", subject=F.col("declaration"), operation=F.col("sink_category"), certainty=F.col("certainty")))

    metrics = D.metric_findings(facts["functions"], {tuple(k.split("/")): (t.report, t.warn, t.fail) for k, t in s.metric_tiers.items()})
    found.append(metrics)
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    every = written(D.remap(J.without_constructors(every, declarations) if any(c.allow_constructor_names for c in s.conventions) else every, rules), "found")
    for policies, apply, key, scanned in (
        (s.allocation_policies, P.allocation_policies, ["rule_id", "path", "line", "column"], True),
        (s.clone_policies, P.clone_policies, ["rule_id", "subject"], False),
        (s.metric_policies, P.metric_policies, ["rule_id", "path", "line", "subject"], True),
        (s.naming_policies, P.naming_policies, ["rule_id", "path", "line", "column", "subject"], True),
    ):
        if policies:
            changed, drift = apply(every, _policy_table(spark, policies, files if scanned else None), key)
            every = written(changed.unionByName(drift), "reviewed")

    counted = L.line_counts(files, lines, facts["doc_lines"])
    inventory = J.file_inventory(counted, facts["functions"], facts["structs"], facts["syntax"])
    frames["files"] = inventory
    frames["statistics"] = A.code_statistics(inventory, facts["functions"])
    frames["languages"] = A.files_by_language(inventory, ("odin", "julia", "markdown"))
    frames.update({k: facts[k] for k in ("functions", "declarations", "imports", "references", "interop")}, calls=calls)
    if s.coverage.enabled:
        frames["test_coverage"] = coverage(spark, root, facts, calls, roots, s)
        frames["coverage_counts"] = A.coverage_counts(frames["test_coverage"])
        frames["coverage_gaps"] = A.high_risk(frames["test_coverage"], s.coverage.high_risk_limit)
    context = {**frames, "files": inventory, "diagnostics": every}
    for phase in X.PHASES[1:]:
        more = X.run_phase(extensions, phase, context, results)
        results += more
        for r in more:
            if r.diagnostics is not None and r.status != "failed":
                every = every.unionByName(D.remap(r.diagnostics.select(*every.columns), rules))
    report.extensions = results
    every = written(every, "all")
    visible, ignored = D.split_ignored(every)
    frames["diagnostics"], frames["ignored"], frames["ignored_findings"] = visible, ignored, every.filter("response = 'Ignore'")
    statuses = [(name, status, None, 0) for name, status in engines] + [(e.extension_id, "not-applicable", None, 0) for e in extensions if all(r.extension_id != e.extension_id for r in results)]
    statuses += [(r.extension_id, r.status, r.message, k) for k, r in enumerate(results)]
    frames["engines"] = D.engine_statuses(_table(spark, statuses, "name string, status string, message string, ord int"))
    frames["rules"] = D.rule_summary(rules, visible, ignored, files, frames["engines"])
    report.exit_code = int(D.exit_code(visible, frames["engines"], s.threshold).first()[0])
    return report


def external_facts(spark: SparkSession, facts: dict[str, DataFrame], s: Settings) -> tuple[dict[str, DataFrame], list[DataFrame], list[tuple[str, str]]]:
    """Facts, findings and engine statuses with those of the configured records.

    Calls, allocations and syntax failures of native summaries take the place of extracted ones of their
    files.  An engine is complete if its records could be read, also if they report failures.
    """
    facts, found, engines = dict(facts), [], []
    if s.external.native:
        native = written(external.native_summaries(spark, s.external.native), "native")
        calls = external.native_calls(native).withColumnRenamed("source_path", "path")
        for name, rows in (("calls", calls), ("allocations", external.native_allocations(native))):
            own = facts[name].join(native.select("path").distinct(), "path", "left_anti")
            position = (F.shiftleft("line", 20) + F.col("column")).cast(own.schema["ord"].dataType)
            facts[name] = written(own.unionByName(rows.withColumn("ord", position).select(*own.columns)), name)
        facts["syntax"] = facts["syntax"].join(native.select("path").distinct(), "path", "left_anti")
        found.append(external.syntax_findings(native))
    records = (
        ("jet", s.external.inference, lambda paths: external.inference_findings(spark, paths)),
        ("odin-build", s.external.builds, lambda paths: external.build_findings(external.read_builds(spark, paths))),
    )
    for engine, paths, findings in records:
        status = "complete" if paths else "not-applicable"
        if paths:
            try:
                found.append(written(findings(paths), engine))
            except PySparkException:
                status = "failed"
        engines.append((engine, status))
    return facts, found, engines


def coverage(spark: SparkSession, root: str, facts: dict[str, DataFrame], calls: DataFrame, roots: DataFrame, s: Settings) -> DataFrame:
    """Declarations with static and runtime evidence of tests."""
    lines = lcov.read(spark, s.coverage.traces, root) if s.coverage.traces else _table(spark, [], "path string, line long, count long")
    functions = facts["functions"].filter("name <> '<anonymous>'").withColumn("id", F.concat_ws(":", "path", "start_line", "name"))
    tests = roots.filter("category = 'test'")
    universe = functions.select("path", "language", "name", F.col("name").alias("qualified_name"), F.lit("function").alias("kind"))
    reached = G.reachable_names(universe, calls, tests, open_callers=False).distinct().withColumn("_reached", F.lit(True))
    tested = tests.select("language").distinct().withColumn("_tested", F.lit(True))
    met = J.boundary_categories(J.coverage_lines(functions, lines, "id"), roots, "id").join(reached, ["language", "name"], "left").join(tested, "language", "left")
    static = F.when(F.col("_tested"), F.coalesce("_reached", F.lit(False)))
    label = S.evidence_class(F.col("static_reachable"), F.col("runtime_covered"))
    marked = met.withColumn("static_reachable", static)
    return marked.select("path", "language", "name", "start_line", "end_line", "executable_lines", "cyclomatic", "static_reachable", "runtime_instrumented_lines", "runtime_covered_lines", "runtime_covered", label.alias("evidence_class"), "boundary_categories", S.risk_score(F.col("cyclomatic"), F.col("executable_lines"), F.size("boundary_categories") > 0).alias("risk_score"), S.evidence_explanation(label).alias("explanation"))


def settings_json(settings: Settings) -> dict:
    return asdict(settings)
