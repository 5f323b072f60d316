"""Closures and components of name graphs: semi-naive loops whose rounds are tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.scalars import terminal_name
from factloom.storage import written


def closure(seeds: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """All nodes ``(keys.., node)`` that the seeds reach over ``(keys.., source, target)``, seeds included.

    Each round joins only the nodes that the last one found.  It ends when none is new, after as many
    rounds as the longest shortest path has edges.
    """
    edges = written(edges.select(*keys, "source", "target").distinct(), "edges")
    reached = written(seeds.select(*keys, "node").distinct(), "seeds")
    frontier, every = reached, [reached]
    while frontier.limit(1).count():
        found = frontier.withColumnRenamed("node", "source").join(edges, [*keys, "source"]).select(*keys, F.col("target").alias("node")).distinct()
        for part in every:
            found = found.join(part, [*keys, "node"], "left_anti")
        frontier = written(found, "frontier")
        every.append(frontier)
        if len(every) > 8:
            merged = every[0]
            for part in every[1:]:
                merged = merged.unionByName(part)
            every = [written(merged, "reached")]
    out = every[0]
    for part in every[1:]:
        out = out.unionByName(part)
    return out


def reachable_names(declarations: DataFrame, edges: DataFrame, roots: DataFrame, open_callers: bool = True) -> DataFrame:
    """``(language, name)`` reached from the roots by last names.

    Seeds are the roots' declarations as they stand.  With ``open_callers``, edges without a caller fire at
    once; without, never.  Only declared callables are reached over edges.
    """
    callables = declarations.filter("kind in ('function', 'procedure')").select("language", "name").distinct()
    named = edges.select("language", terminal_name(F.col("caller")).alias("source"), terminal_name(F.col("callee")).alias("name")).join(callables, ["language", "name"], "left_semi")
    seeds = roots.select("language", F.col("declaration").alias("node"))
    if open_callers:
        seeds = seeds.unionByName(named.filter("source = ''").select("language", F.col("name").alias("node")))
    found = closure(seeds, named.filter("source <> ''").select("language", "source", F.col("name").alias("target")), ["language"])
    return found.select("language", F.col("node").alias("name"))


def unreachable(declarations: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Callables that no root reaches; none without roots of their language."""
    callables = declarations.filter("kind in ('function', 'procedure')")
    rooted = callables.join(roots.select("language").distinct(), "language", "left_semi")
    return rooted.join(reachable_names(declarations, edges, roots).distinct(), ["language", "name"], "left_anti")


def is_test_path(path):
    """``test/`` directories, ``_test.jl`` and ``_tests.odin`` files."""
    return path.startswith("test/") | path.contains("/test/") | path.endswith("_test.jl") | path.endswith("_tests.odin")


def call_roots(declarations: DataFrame, signatures: DataFrame, configured: DataFrame, inferred: DataFrame) -> DataFrame:
    """Distinct roots ``(id, path, language, declaration, category)`` of all kinds.

    Production: inferred entries, ``main`` procedures; test: callables of test files; bridge and callback:
    exported signatures; and the configured ones.
    """
    callables = declarations.filter("kind in ('function', 'procedure')")
    tests = callables.filter(is_test_path(F.col("path"))).select(F.concat(F.lit("test:"), F.col("qualified_name")).alias("id"), "path", "language", F.col("name").alias("declaration"), F.lit("test").alias("category"))
    mains = callables.filter("name = 'main'").select(F.concat_ws(":", F.lit("main"), "language", "path").alias("id"), "path", "language", F.col("name").alias("declaration"), F.lit("production").alias("category"))
    category = F.when(F.col("direction") == "export", "bridge").otherwise("callback")
    bridges = signatures.filter("direction in ('export', 'callback')").select(F.concat_ws(":", category, F.col("symbol"), F.col("path")).alias("id"), "path", "language", F.col("symbol").alias("declaration"), category.alias("category"))
    chosen = configured.select(F.concat_ws(":", "id", "path").alias("id"), "path", "language", terminal_name(F.col("qualified_name")).alias("declaration"), "category")
    return tests.unionByName(mains).unionByName(bridges).unionByName(chosen).unionByName(inferred.select("id", "path", "language", "declaration", "category")).distinct()


#: Edges of a graph that one task takes (about 200 MB there); the result does not depend on it.
ONE_TASK = 1 << 20


def mutual_components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """Strongly connected components of more than one node: ``(component, members, size)``, the least member first.

    Graphs of at most ``one_task`` edges go through one task.  Of larger ones, nodes without a predecessor or
    successor are trimmed; every node takes the least name that reaches it as its colour; and the nodes of a colour
    that reach its namesake are a component.  What is left goes round again.  No closure is built.
    """
    left = written(edges.select("source", "target").filter("source <> target").distinct(), "edges")
    found: list[DataFrame] = []
    while left.count() > one_task:
        left, trimmed = _trimmed(left), left
        if left.count() < trimmed.count():
            continue
        names = left.select(F.col("source").alias("node"))
        colours = _least_reaching(names.distinct(), left)
        of = lambda c: colours.select(F.col("node").alias(c), F.col("colour").alias(f"{c}_colour"))
        inside = left.join(of("source"), "source").join(of("target"), "target").filter("source_colour = target_colour").select(F.col("source_colour").alias("colour"), F.col("target").alias("source"), F.col("source").alias("target"))
        back = closure(colours.filter("node = colour").select("colour", "node"), inside, ["colour"])
        done = written(back, "components")
        found.append(done.withColumnRenamed("colour", "root"))
        ends = done.select(F.col("node"))
        left = written(left.join(ends.withColumnRenamed("node", "source"), "source", "left_anti").join(ends.withColumnRenamed("node", "target"), "target", "left_anti").select("source", "target"), "left")
    out = left.repartition(1).mapInArrow(_components_of_batches, "root string, node string")
    for part in found:
        out = out.unionByName(part.select("root", "node"))
    groups = out.groupBy("root").agg(F.array_sort(F.collect_set("node")).alias("members")).filter(F.size("members") > 1)
    return groups.select(F.element_at("members", 1).alias("component"), "members", F.size("members").cast("long").alias("size"))


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have both a predecessor and a successor."""
    targets, sources = edges.select(F.col("target").alias("source")).distinct(), edges.select(F.col("source").alias("target")).distinct()
    return written(edges.join(targets, "source", "left_semi").join(sources, "target", "left_semi").select("source", "target"), "trimmed")


def _least_reaching(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, colour)``: the least node that reaches each node, itself included, by rounds of minima over edges."""
    now = written(nodes.select("node", F.col("node").alias("colour"), F.lit(True).alias("fresh")), "colours")
    while now.filter("fresh").limit(1).count():
        sent = now.filter("fresh").withColumnRenamed("node", "source").join(edges, "source").groupBy(F.col("target").alias("node")).agg(F.min("colour").alias("offer"))
        better = F.col("offer") < F.col("colour")
        now = written(now.join(sent, "node", "left").select("node", F.when(better, F.col("offer")).otherwise(F.col("colour")).alias("colour"), F.coalesce(better, F.lit(False)).alias("fresh")), "colours")
    return now.select("node", "colour")


def strong_components(source: list[str], target: list[str]) -> list[list[str]]:
    """Strongly connected components of more than one node, by depth-first search with low links, without recursion."""
    after: dict[str, list[str]] = {}
    for u, v in zip(source, target):
        after.setdefault(u, []).append(v)
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    on: set[str] = set()
    out: list[list[str]] = []
    for start in after:
        if start in index:
            continue
        path = [(start, iter(after[start]))]
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        while path:
            node, rest = path[-1]
            for child in rest:
                if child not in index:
                    index[child] = low[child] = len(index)
                    stack.append(child)
                    on.add(child)
                    path.append((child, iter(after.get(child, ()))))
                    break
                if child in on:
                    low[node] = min(low[node], index[child])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == index[node]:
                    group = []
                    while not group or group[-1] != node:
                        group.append(stack.pop())
                        on.discard(group[-1])
                    if len(group) > 1:
                        out.append(group)
    return out


def _components_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    source, target = [], []
    for batch in batches:
        source += batch.column("source").to_pylist()
        target += batch.column("target").to_pylist()
    rows = [(min(group), node) for group in strong_components(source, target) for node in group]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["root", "node"])


def dependency_cycles(layer_edges: DataFrame) -> DataFrame:
    """Cyclic layer groups with their first edge (by ``ord``) that crosses layers inside the group."""
    groups = mutual_components(layer_edges.select(F.col("source_layer").alias("source"), F.col("target_layer").alias("target")))
    owner = groups.select("component", "members", "size", F.explode("members").alias("source_layer"))
    inside = layer_edges.filter("source_layer <> target_layer").join(owner, "source_layer").filter(F.array_contains("members", F.col("target_layer")))
    return inside.groupBy("component").agg(F.first("members").alias("members"), F.first("size").alias("size"), F.min_by(F.struct("source_path", "line", "column", "target"), "ord").alias("evidence"))
