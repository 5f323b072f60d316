"""Derived relations by joins: anti, semi, range, longest prefix, first match, wildcard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import scalars as S

#: Lines (or other units) of one bin of a range join.
BIN = 512


def binned_range_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str, width: int = BIN) -> DataFrame:
    """Inner join of points to the intervals ``[start, end]`` of the same keys that hold them.

    Both sides get bins of ``width`` units as a further equality key, intervals once for each bin they
    touch, so a key with very many rows is spread over its bins.  Each pair comes once: a point has one bin.
    """
    left = points.withColumn("_bin", F.floor(F.col(at) / width))
    right = intervals.filter(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return left.join(right, [*keys, "_bin"]).filter(F.col(at).between(F.col(start), F.col(end))).drop("_bin")


def narrowest(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point_id: str, at: str, start: str, end: str, order: Sequence[str], width: int = BIN) -> DataFrame:
    """Each point with the narrowest interval that holds it (ties: the first by ``order``); null if none does."""
    kept = [c for c in intervals.columns if c not in keys]
    met = binned_range_join(points.select(point_id, *keys, at), intervals, keys, at, start, end, width)
    best = met.groupBy(point_id).agg(F.min(F.struct((F.col(end) - F.col(start)).alias("_width"), *order, *[c for c in kept if c not in order])).alias("_best"))
    return points.join(best, point_id, "left").select(*points.columns, *(F.col(f"_best.{c}").alias(c) for c in kept))


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the left side whose keys the right side lacks."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def unused_imports(bindings: DataFrame, references: DataFrame) -> DataFrame:
    """Imported names that their file never mentions."""
    return unmatched(bindings, references, ["path", "language", "name"])


def owning_layer(paths: DataFrame, prefixes: Sequence[tuple[str, str]], column: str = "path") -> DataFrame:
    """Adds ``layer``: that of the longest prefix that is the path or a directory above it; ``.`` owns all.

    ``prefixes`` are (prefix, layer) pairs of configuration.  ``.`` has length one, so it ties with a one-letter
    directory, and the first in order wins.  The choice is one expression: no join, no shuffle.
    """
    path = F.col(column)
    owner: Column = F.lit(None).cast("string")
    ranked = sorted(enumerate(prefixes), key=lambda p: (len(p[1][0]), -p[0]))
    for _, (prefix, layer) in ranked:
        holds = F.lit(True) if prefix == "." else (path == prefix) | path.startswith(prefix + "/")
        owner = F.when(holds, layer).otherwise(owner)
    return paths.withColumn("layer", owner)


def layer_edges(dependencies: DataFrame, prefixes: Sequence[tuple[str, str]]) -> DataFrame:
    """Dependency edges with both layers; edges without two owned ends are dropped."""
    edges = owning_layer(dependencies, prefixes, "source_path").withColumnRenamed("layer", "source_layer")
    edges = owning_layer(edges, prefixes, "target_path").withColumnRenamed("layer", "target_layer")
    return edges.filter("source_layer is not null and target_layer is not null and target_path is not null")


def forbidden(edges: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges between different layers that are not allowed: one row per edge."""
    return edges.filter("source_layer <> target_layer").join(allowed.select("source_layer", "target_layer").distinct(), ["source_layer", "target_layer"], "left_anti")


def unresolved_imports(dependencies: DataFrame) -> DataFrame:
    return dependencies.filter("resolution = 'unresolved'")


def innermost_module(edges: DataFrame, modules: DataFrame, edge_id: str) -> DataFrame:
    """Adds the name of the deepest module of the edge's file whose lines hold it (``module``, null if none)."""
    spans = modules.select(F.col("path").alias("source_path"), "name", "start_line", "end_line", "depth")
    met = binned_range_join(edges.select(edge_id, "source_path", "line"), spans, ["source_path"], "line", "start_line", "end_line")
    deepest = met.groupBy(edge_id).agg(F.max_by("name", "depth").alias("module"))
    return edges.join(deepest, edge_id, "left")


def resolve_julia(edges: DataFrame, modules: DataFrame, edge_id: str) -> DataFrame:
    """Resolve imports to module files.

    An absolute target is a module or lies below one; a relative one climbs from the innermost module, one
    level for each dot after the first, and must be a module itself.  The deepest module wins; without one,
    absolute targets are external and relative ones unresolved.  Candidate names are the target's
    prefixes, so the join is by equality.
    """
    inner = innermost_module(edges, modules, edge_id)
    dots = F.length(F.regexp_extract("target", r"^(\.*)", 1))
    rest = F.regexp_replace("target", r"^\.+", "")
    scope = F.split("module", r"\.")
    base = F.array_join(F.slice(scope, 1, F.size(scope) - dots + 1), ".")
    parts = F.split(rest, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    climbed = F.when(F.col("module").isNotNull() & (dots <= F.size(scope)), F.array(F.concat(base, F.lit("."), rest)))
    prefixes = F.when(dots == 0, above).otherwise(climbed)
    candidates = inner.select(edge_id, F.explode(prefixes).alias("name"))
    best = candidates.join(modules.select("name", "depth", "path"), "name").groupBy(edge_id).agg(F.max_by("path", F.struct("depth", F.length("name"))).alias("found"))
    joined = inner.join(best, edge_id, "left")
    resolution = F.when(F.col("found").isNotNull(), "repository").when(dots == 0, "external").otherwise("unresolved")
    kept = [c for c in edges.columns if c not in ("target_path", "resolution")]
    return joined.select(*kept, F.col("found").alias("target_path"), resolution.alias("resolution"))


def directories(files: DataFrame) -> DataFrame:
    """All directories above the files, with ``.`` for the root."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, 1, F.greatest(k, F.lit(1))), "/")))
    return files.select(F.explode(above).alias("directory")).distinct()


def normalized(path: Column) -> Column:
    """Path with ``.`` and ``..`` segments folded; null if it climbs out; ``.`` for the root."""
    step = lambda acc, x: F.when((x == "") | (x == "."), acc).when(
        x == "..", F.when(acc.isNull() | (F.size(acc) == 0), F.lit(None).cast("array<string>")).otherwise(F.slice(acc, 1, F.size(acc) - 1))
    ).otherwise(F.when(acc.isNotNull(), F.concat(acc, F.array(x))))
    folded = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(folded.isNotNull(), F.when(F.size(folded) == 0, ".").otherwise(F.array_join(folded, "/")))


def resolve_odin(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Imports with a colon are external; others name a directory from the importing file: in the repository or unresolved."""
    folder = F.regexp_replace("source_path", r"(^|/)[^/]*$", "")
    place = normalized(F.concat_ws("/", folder, F.col("target")))
    marked = edges.withColumn("_place", F.when(~F.col("target").contains(":"), place))
    known = directories(files).withColumn("_known", F.lit(True))
    joined = marked.join(known, marked["_place"] == known["directory"], "left")
    resolution = F.when(F.col("target").contains(":"), "external").when(F.col("_known"), "repository").otherwise("unresolved")
    kept = [c for c in edges.columns if c not in ("target_path", "resolution")]
    return joined.select(*kept, F.when(F.col("_known"), F.col("_place")).alias("target_path"), resolution.alias("resolution"))


def signature_mismatch(left: str, right: str) -> Column:
    """The first difference of two signatures: convention, parameters, returns; null if they agree."""
    text = lambda side, name: F.array_join(F.col(f"{side}.{name}"), ", ")
    differ = lambda name: F.col(f"{left}.{name}") != F.col(f"{right}.{name}")
    return (
        F.when(differ("calling_convention"), F.concat(F.lit("calling convention "), F.col(f"{left}.calling_convention"), F.lit(" != "), F.col(f"{right}.calling_convention")))
        .when(differ("parameter_types"), F.concat(F.lit("parameter types "), text(left, "parameter_types"), F.lit(" != "), text(right, "parameter_types")))
        .when(differ("return_types"), F.concat(F.lit("return types "), text(left, "return_types"), F.lit(" != "), text(right, "return_types")))
    )


def pair_signatures(signatures: DataFrame) -> DataFrame:
    """``symbol, status, julia_path, odin_path, mismatch`` of foreign-call signatures with an order ``ord``.

    Each Julia import without a library meets the first Odin export of its symbol.  Exports that no import
    met (later ones of a symbol as well) are missing on the Julia side; all other signatures are external.
    """
    s = signatures.withColumn("library", F.nullif("library", F.lit("")))
    fields = F.struct("calling_convention", "parameter_types", "return_types", "path", "ord")
    imports = s.filter("language = 'julia' and direction = 'import' and library is null").select("symbol", fields.alias("j"))
    exports = s.filter("language = 'odin' and direction = 'export'").select("symbol", fields.alias("o"))
    first = exports.groupBy("symbol").agg(F.min_by("o", "o.ord").alias("o"))
    met = imports.join(first, "symbol", "left")
    difference = signature_mismatch("j", "o")
    found = met.select("symbol", F.when(F.col("o").isNull(), "missing-odin").when(difference.isNull(), "matched").otherwise("signature-mismatch").alias("status"), F.col("j.path").alias("julia_path"), F.col("o.path").alias("odin_path"), difference.alias("mismatch"))
    used = first.join(imports.select("symbol").distinct(), "symbol", "left_semi").select("symbol", F.col("o.ord").alias("ord"))
    alone = exports.select("symbol", F.col("o.ord").alias("ord"), F.col("o.path").alias("path")).join(used, ["symbol", "ord"], "left_anti")
    none = F.lit(None).cast("string")
    missing = alone.select("symbol", F.lit("missing-julia").alias("status"), none.alias("julia_path"), F.col("path").alias("odin_path"), none.alias("mismatch"))
    outside = s.filter("(language = 'julia' and (direction <> 'import' or library is not null)) or (language = 'odin' and direction <> 'export')")
    external = outside.select("symbol", F.lit("external").alias("status"), F.when(F.col("language") == "julia", F.col("path")).alias("julia_path"), F.when(F.col("language") == "odin", F.col("path")).alias("odin_path"), none.alias("mismatch"))
    return found.unionByName(missing).unionByName(external)


def contract_calls(edges: DataFrame, contracts: DataFrame) -> DataFrame:
    """Call edges with every contract ``(id, language, declaration, category)`` they satisfy.

    Qualified declarations match whole, others by the call's last name: two equality joins.
    """
    side = contracts.select("language", F.col("declaration").alias("_wanted"), "id", "category")
    dotted = F.col("_wanted").contains(".")
    columns = [*edges.columns, "id", "category"]
    whole = edges.withColumn("_wanted", F.col("callee")).join(side.filter(dotted), ["language", "_wanted"]).select(*columns)
    named = edges.withColumn("_wanted", S.terminal_name(F.col("callee"))).join(side.filter(~dotted), ["language", "_wanted"]).select(*columns)
    return whole.unionByName(named)


def source_before_sink(sources: DataFrame, sinks: DataFrame, between: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Pairs of source and sink of one key, source strictly first, with the sorted ids strictly in between.

    Inputs carry ``keys``, ``order`` columns, ``id`` and (sources, sinks) any others, which come out as
    ``source_*`` and ``sink_*``.  Sanitizers are gathered by a range join for the pairs that exist.
    """
    at = lambda side: F.struct(*(F.col(f"{side}_{c}") for c in order))
    rename = lambda df, side: df.select(*keys, *(F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in keys))
    pairs = rename(sources, "source").join(rename(sinks, "sink"), list(keys)).filter(at("source") < at("sink"))
    marks = between.select(*keys, F.struct(*order).alias("_at"), F.col("id").alias("_id"))
    held = pairs.join(marks, list(keys), "left").withColumn("_id", F.when((F.col("_at") > at("source")) & (F.col("_at") < at("sink")), F.col("_id")))
    return held.groupBy(*pairs.columns).agg(F.array_sort(F.collect_list("_id")).alias("sanitizers"))


def security_paths(edges: DataFrame, sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame) -> DataFrame:
    """Configured sources before sinks within declarations of one language and last name.

    Paths of equal identity (language, path, declaration, both contracts and lines) are one.
    """
    named = edges.withColumn("declaration", S.terminal_name(F.col("caller"))).filter("declaration <> ''")
    columns = ["language", "declaration", "line", "column", "id"]
    found = source_before_sink(
        contract_calls(named, sources).select(*columns, F.col("source_path").alias("path"), F.col("callee").alias("call"), "category"),
        contract_calls(named, sinks).select(*columns, F.col("callee").alias("call"), "category"),
        contract_calls(named, sanitizers).select(*columns),
        ["language", "declaration"],
        ["line", "column"],
    )
    observed = F.when(F.size("sanitizers") == 0, F.lit("No configured sanitizer call was observed.")).otherwise(F.concat(F.lit("Observed sanitizer calls: "), F.array_join("sanitizers", ", "), F.lit(".")))
    rows = found.withColumn("explanation", F.concat(F.lit("Configured source "), F.col("source_id"), F.lit(" precedes sink "), F.col("sink_id"), F.lit(" in one declaration. "), observed, F.lit(" Argument flow is not yet proven.")))
    identity = ["language", "source_path", "declaration", "source_id", "source_line", "sink_id", "sink_line"]
    return rows.groupBy(*identity).agg(*(F.min_by(c, F.struct("source_column", "sink_column")).alias(c) for c in ("source_call", "source_category", "sink_call", "sink_category", "sanitizers", "explanation"))).withColumn("certainty", F.lit("potential"))


def contract_lifetimes(events: DataFrame, contracts: DataFrame, key: list[str]) -> DataFrame:
    """Allocation events with their only matching contract, or why there is none.

    A contract matches its category, and operation and allocator where it gives them; contracts carry an
    order ``ord``.  The join is by category.
    """
    side = contracts.select(*(F.col(c).alias(f"c_{c}") for c in contracts.columns))
    fits = (F.col("category") == F.col("c_category")) & (F.col("c_operation").isNull() | (F.col("c_operation") == F.col("operation"))) & (F.col("c_allocator_source").isNull() | (F.col("c_allocator_source") == F.col("allocator_source")))
    met = events.select(*key, "category", "operation", "allocator_source").join(side, fits)
    body = [f"c_{c}" for c in contracts.columns if c not in ("category", "operation", "allocator_source")]
    per = met.groupBy(*key).agg(F.count("*").alias("matches"), F.array_sort(F.collect_list(F.struct("c_ord", *[b for b in body if b != "c_ord"]))).alias("found"))
    joined = events.join(per, key, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    one = F.col("matches") == 1
    chosen = lambda c: F.when(one, F.element_at("found", 1)[f"c_{c}"])
    ids = F.array_join(F.transform("found", lambda x: x["c_id"]), ", ")
    return joined.select(
        *events.columns,
        chosen("id").alias("contract_id"),
        F.coalesce(chosen("ownership"), F.lit("unknown")).alias("ownership"),
        F.coalesce(chosen("lifetime"), F.lit("unknown")).alias("lifetime"),
        chosen("release_operation").alias("release_operation"),
        chosen("allows_escape").alias("allows_escape"),
        F.when(one, "complete").when(F.col("matches") == 0, "unresolved").otherwise("ambiguous").alias("status"),
        F.when(one, chosen("reason")).when(F.col("matches") == 0, "No configured resource lifetime contract matched this allocation.").otherwise(F.concat(F.lit("Multiple resource lifetime contracts matched: "), ids, F.lit("."))).alias("explanation"),
    )


def coverage_lines(functions: DataFrame, lines: DataFrame, function_id: str) -> DataFrame:
    """Functions with counts of instrumented and covered lines in their span and ``runtime_covered`` (null without any)."""
    spans = functions.select(function_id, "path", "start_line", "end_line")
    met = binned_range_join(lines.select("path", "line", "count"), spans, ["path"], "line", "start_line", "end_line")
    per = met.groupBy(function_id).agg(F.count("*").alias("instrumented"), F.count_if(F.col("count") > 0).alias("covered"))
    joined = functions.join(per, function_id, "left")
    return joined.select(
        *functions.columns,
        F.coalesce("instrumented", F.lit(0)).alias("runtime_instrumented_lines"),
        F.coalesce("covered", F.lit(0)).alias("runtime_covered_lines"),
        F.when(F.col("instrumented").isNotNull(), F.col("covered") > 0).alias("runtime_covered"),
    )


def boundary_categories(functions: DataFrame, roots: DataFrame, function_id: str) -> DataFrame:
    """Functions with the sorted callback and bridge categories of their roots."""
    marks = roots.filter("category in ('callback', 'bridge')").select("language", "path", S.terminal_name(F.col("declaration")).alias("name"), "category").distinct()
    per = functions.select(function_id, "language", "path", "name").join(marks, ["language", "path", "name"]).groupBy(function_id).agg(F.array_sort(F.collect_set("category")).alias("boundary_categories"))
    return functions.join(per, function_id, "left").withColumn("boundary_categories", F.coalesce("boundary_categories", F.array().cast("array<string>")))


def configured_roots(declarations: DataFrame, entries: DataFrame) -> DataFrame:
    """Entry points ``(id, language, name, category)`` with the callables of that name or qualified name: two equality joins."""
    callables = declarations.filter("kind in ('function', 'procedure')")
    by_name = callables.join(entries, ["language", "name"]).select("id", "language", "path", "qualified_name", "category")
    side = entries.withColumnRenamed("name", "qualified_name")
    by_path = callables.join(side, ["language", "qualified_name"]).select("id", "language", "path", "qualified_name", "category")
    return by_name.unionByName(by_path).distinct()


def root_drift(declarations: DataFrame, entries: DataFrame) -> DataFrame:
    """Entry points that match no declared callable."""
    return entries.join(configured_roots(declarations, entries).select("id").distinct(), "id", "left_anti")


def value_edges(declarations: DataFrame, references: DataFrame) -> DataFrame:
    """Callables mentioned as values: edges from the enclosing callable, if the scope's last name is one."""
    callables = declarations.filter("kind in ('function', 'procedure')").select("language", "name").distinct()
    sites = declarations.select("path", "name", "line").distinct()
    used = references.join(callables, ["language", "name"], "left_semi").join(sites, ["path", "name", "line"], "left_anti")
    enclosing = callables.select("language", F.col("name").alias("_last"), F.lit(True).alias("_callable"))
    joined = used.withColumn("_last", S.terminal_name(F.col("scope"))).join(enclosing, ["language", "_last"], "left")
    return joined.select(F.col("path").alias("source_path"), "language", F.when(F.col("_callable"), F.col("scope")).alias("caller"), F.col("name").alias("callee"), F.lit("value").alias("kind"), "line", "column")


def without_constructors(found: DataFrame, declarations: DataFrame) -> DataFrame:
    """Naming findings of Julia functions go where a Julia type anywhere has the name."""
    types = declarations.filter("language = 'julia' and kind = 'type'").select(F.col("name").alias("subject")).distinct()
    affected = F.coalesce((F.col("rule_id") == "JULIA-NAMING") & (F.col("operation") == "function"), F.lit(False))
    return found.filter(~affected).unionByName(found.filter(affected).join(types, "subject", "left_anti").select(*found.columns))


def allocation_rules(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """Unknown allocations take the category of a configured allocator text ``(allocator_source, category)``."""
    joined = found.join(patterns, "allocator_source", "left")
    named = F.concat(F.lit("ODIN-ALLOCATION-"), F.upper(F.replace("category", F.lit("_"), F.lit("-"))))
    rule = F.when((F.col("rule_id") == "ODIN-ALLOCATION-UNKNOWN") & F.col("category").isNotNull(), named).otherwise(F.col("rule_id"))
    return joined.select(*(rule.alias(c) if c == "rule_id" else c for c in found.columns))


def file_inventory(files: DataFrame, functions: DataFrame, structs: DataFrame, failures: DataFrame) -> DataFrame:
    """Files with counts of functions and structs, and whether they were parsed."""
    n = functions.groupBy("path").agg(F.count("*").alias("function_count"))
    m = structs.groupBy("path").agg(F.sum("structs").alias("struct_count"))
    bad = failures.select("path").distinct().withColumn("_bad", F.lit(True))
    joined = files.join(n, "path", "left").join(m, "path", "left").join(bad, "path", "left")
    return joined.select(*files.columns, F.coalesce("function_count", F.lit(0)).alias("function_count"), F.coalesce("struct_count", F.lit(0)).alias("struct_count"), F.col("_bad").isNull().alias("parsed"))
