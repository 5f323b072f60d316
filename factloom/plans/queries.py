"""Registered queries: each is an adapter projection of a driver table and the production operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import scalars as S
from factloom.operators import aggregates as A
from factloom.operators import findings as D
from factloom.operators import graph as G
from factloom.operators import joins as J
from factloom.operators import lines as L
from factloom.operators import policies as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text):
    return F.size(F.split(text, " "))


@query
def clone_groups(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    rows = docs.select("lang", F.col("text").alias("body"), F.col("doc_id").alias("occurrence")).withColumns({"language": F.col("lang"), "token_count": words("body"), "executable_lines": F.size(F.split("body", "\n"))})
    return A.clone_groups(rows, 2, 10, 1)


@query
def clone_members(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    rows = docs.select(F.col("lang").alias("language"), F.col("text").alias("body"), F.col("doc_id").alias("occurrence"), words("text").alias("token_count"), F.lit(1).alias("executable_lines"))
    return A.clone_members(rows, A.clone_groups(rows, 2))


@query
def line_length_tiers(spark, sf_dir):
    lines = L.lines_of(read(spark, sf_dir, "documents"), ["lang"])
    tier = L.width_tier(F.length("content"))
    return lines.select("lang", tier.alias("rule_id"), F.length("content").alias("width")).filter("rule_id is not null").groupBy("lang", "rule_id").agg(F.count("*").alias("findings"), F.max("width").alias("widest"))


@query
def file_line_counts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("lang").alias("language"), "text")
    lines = L.lines_of(docs, ["path"]).select("path", "line", "content", (F.trim("content") == "").alias("blank"), F.col("content").startswith("#").alias("comment"))
    return L.line_counts(docs, lines)


def _files(spark, sf_dir):
    text = F.col("text")
    n = F.size(F.split(text, "\n"))
    return read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("language"), n.alias("physical_lines"), n.alias("source_lines"), n.alias("code_lines"), F.lit(0).alias("comment_lines"), F.lit(0).alias("blank_lines"), (F.col("doc_id") % 3).alias("struct_count"), "n_chars")


@query
def language_statistics(spark, sf_dir):
    files = _files(spark, sf_dir)
    functions = files.select("language", (F.col("n_chars") % 7 + 1).alias("cyclomatic"))
    out = A.code_statistics(files, functions, ("en", "de", "fr", "es"))
    return out.withColumn("density", F.round("density", 6))


@query
def effort_estimates(spark, sf_dir):
    files = _files(spark, sf_dir)
    per = A.code_statistics(files, files.select("language", (F.col("n_chars") % 7 + 1).alias("cyclomatic")), ("en", "de", "fr", "es"))
    c, m = A.cocomo(F.col("code_lines")), A.locomo(F.col("code_lines"), F.col("complexity"))
    return per.select("language", *(F.round(v, 4).alias(f"cocomo_{k}") for k, v in c.items()), *(F.round(v, 4).alias(f"locomo_{k}") for k, v in m.items()))


@query
def files_by_language(spark, sf_dir):
    return A.files_by_language(read(spark, sf_dir, "documents").withColumnRenamed("lang", "language"), ("en", "de", "fr", "es", "pt"))


@query
def unlabelled_documents(spark, sf_dir):
    return J.unmatched(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), read(spark, sf_dir, "labels"), ["doc_id"])


@query
def orders_without_lines(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.unmatched(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), lines, ["o_orderkey"])


LAYERS = [(".", "root"), ("en", "english"), ("en/7", "english-seven"), ("en/78", "english-seventy-eight"), ("de", "german"), ("fr", "french")]


@query
def layer_ownership(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://[^/]*/([^?]*)", 1).alias("path"))
    return J.owning_layer(pages, LAYERS)


def _regions(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    return nation.join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")


def _trade(spark, sf_dir):
    """All line items as edges between the customer's and the supplier's nation."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("source_nation"))
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("target_nation"))
    met = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return met.select("o_orderkey", "source_nation", "target_nation")


@query
def forbidden_dependency(spark, sf_dir):
    regions = _regions(spark, sf_dir)
    edges = _trade(spark, sf_dir).join(regions.select(F.col("n_nationkey").alias("source_nation"), F.col("r_name").alias("source_layer")), "source_nation").join(regions.select(F.col("n_nationkey").alias("target_nation"), F.col("r_name").alias("target_layer")), "target_nation")
    allowed = spark.createDataFrame([("ASIA", "EUROPE"), ("EUROPE", "ASIA"), ("AMERICA", "ASIA"), ("AFRICA", "EUROPE")], "source_layer string, target_layer string")
    return J.forbidden(edges, allowed).select("o_orderkey", "source_layer", "target_layer")


@query
def interop_pairing(spark, sf_dir):
    empty = F.array().cast("array<string>")
    imports = read(spark, sf_dir, "customer").select(F.concat(F.lit("julia/"), F.col("c_custkey")).alias("path"), F.lit("julia").alias("language"), F.col("c_nationkey").cast("string").alias("symbol"), F.lit("import").alias("direction"), F.when(F.col("c_custkey") % 10 == 0, "libc").alias("library"), F.lit("c").alias("calling_convention"), F.array(F.when(F.col("c_custkey") % 3 == 0, "i32").otherwise("i64")).alias("parameter_types"), empty.alias("return_types"), F.col("c_custkey").alias("ord"))
    exports = read(spark, sf_dir, "supplier").select(F.concat(F.lit("odin/"), F.col("s_suppkey")).alias("path"), F.lit("odin").alias("language"), F.col("s_nationkey").cast("string").alias("symbol"), F.lit("export").alias("direction"), F.lit(None).cast("string").alias("library"), F.lit("c").alias("calling_convention"), F.array(F.when(F.col("s_suppkey") % 2 == 0, "i32").otherwise("i64")).alias("parameter_types"), empty.alias("return_types"), F.col("s_suppkey").alias("ord"))
    return J.pair_signatures(imports.unionByName(exports))


@query
def source_before_sink(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", "event_type", F.col("event_id").alias("id"))
    of = lambda kind: events.filter(F.col("event_type") == kind).select("user_id", "day", "ts", "event_id", "id")
    found = J.source_before_sink(of("signup"), of("purchase"), of("view"), ["user_id", "day"], ["ts", "event_id"])
    return found.select("user_id", "source_id", "sink_id", F.array_join(F.transform("sanitizers", lambda x: x.cast("string")), ",").alias("sanitizers"))


CONTRACTS = [
    ("view-any", 1, "view", None, None),
    ("click-one", 2, "click", "1", None),
    ("click-two", 3, "click", None, "2"),
    ("purchase", 4, "purchase", "3", "0"),
    ("error-any", 5, "error", None, None),
    ("error-zero", 6, "error", "0", None),
]


@query
def contract_match(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("category"), (F.col("event_id") % 4).cast("string").alias("operation"), (F.col("user_id") % 3).cast("string").alias("allocator_source"))
    contracts = spark.createDataFrame(CONTRACTS, "id string, ord int, category string, operation string, allocator_source string").withColumns({"ownership": F.lit("caller"), "lifetime": F.lit("scope"), "release_operation": F.lit(None).cast("string"), "allows_escape": F.lit(False), "reason": F.concat(F.lit("reviewed "), F.col("id"))})
    return J.contract_lifetimes(events, contracts, ["event_id"]).select("event_id", "category", "contract_id", "ownership", "status", "explanation")


def _evidence(spark, sf_dir):
    """Orders as declarations of lines 1 to 3, line items as trace lines, customers of nation 1 as bridges."""
    functions = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderstatus").alias("language"), F.concat(F.lit("f"), F.col("o_orderkey")).alias("name"), F.lit(1).alias("start_line"), F.lit(3).alias("end_line"), (F.col("o_custkey") % 40 + 1).alias("executable_lines"), (F.col("o_orderkey") % 17 + 1).alias("cyclomatic"), "o_orderpriority")
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").alias("line")).agg(F.sum((F.col("l_quantity") > 25).cast("int")).alias("count"))
    roots = functions.filter("id % 11 = 0").select("language", "path", F.col("name").alias("declaration"), F.lit("bridge").alias("category"))
    met = J.boundary_categories(J.coverage_lines(functions, lines, "id"), roots, "id")
    static = F.when(F.col("o_orderpriority") == "1-URGENT", True).when(F.col("o_orderpriority") == "5-LOW", F.lit(None).cast("boolean")).otherwise(F.lit(False))
    marked = met.withColumn("static_reachable", static)
    return marked.select(
        "id", "path", "language", "name", "start_line", "static_reachable", "runtime_instrumented_lines", "runtime_covered_lines", "runtime_covered",
        S.evidence_class(F.col("static_reachable"), F.col("runtime_covered")).alias("evidence_class"),
        F.array_join("boundary_categories", ",").alias("boundary_categories"),
        S.risk_score(F.col("cyclomatic"), F.col("executable_lines"), F.size("boundary_categories") > 0).alias("risk_score"),
    )


@query
def coverage_range_join(spark, sf_dir):
    return _evidence(spark, sf_dir).withColumn("explanation", S.evidence_explanation(F.col("evidence_class"))).drop("name", "start_line")


@query
def coverage_counts(spark, sf_dir):
    return A.coverage_counts(_evidence(spark, sf_dir))


@query
def high_risk_topk(spark, sf_dir):
    return A.high_risk(_evidence(spark, sf_dir), 20).select("id", "language", "evidence_class", "risk_score")


@query
def narrowest_interval(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    day = F.datediff("o_orderdate", F.lit("1990-01-01").cast("date"))
    spans = orders.select(F.col("o_custkey").alias("path"), day.alias("start"), (day + 10 + F.col("o_orderkey") % 90).alias("end"), F.col("o_orderkey").alias("scope"))
    lines = read(spark, sf_dir, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("path")), "l_orderkey").groupBy("path", F.datediff("l_shipdate", F.lit("1990-01-01").cast("date")).alias("at")).agg(F.count("*").alias("lines"))
    points = lines.withColumn("point", F.concat_ws("/", F.col("path").cast("string"), F.col("at").cast("string")))
    return J.narrowest(points, spans, ["path"], "point", "at", "start", "end", ["scope"]).select("point", "lines", "scope")


RANKS = {"view": 1, "click": 2, "signup": 3, "purchase": 4, "error": 5}


@query
def heading_jump(spark, sf_dir):
    rank = F.element_at(F.create_map(*[F.lit(x) for item in RANKS.items() for x in item]), F.col("event_type"))
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", rank.alias("level"))
    return D.jumps(events, ["user_id"], ["ts", "event_id"], "level").select("user_id", "event_id", "previous", "level")


@query
def heading_count(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_count("html", F.lit("<h1")).cast("long").alias("headings"), (F.regexp_count("html", F.lit("<h1")) != 1).alias("finding"))


@query
def relative_links(spark, sf_dir):
    links = read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("destination"))
    target = F.col("destination")
    kind = F.when(target.startswith("#"), "anchor").when(target.startswith("//"), "network").when(target.startswith("/"), "absolute").when(F.lower(target).rlike(r"^[a-z][a-z\d+.-]*:"), "scheme").otherwise("relative")
    return links.groupBy(kind.alias("kind")).agg(F.count("*").alias("links"), F.countDistinct("page_id").alias("pages"))


@query
def declaration_order(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag").distinct()
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"]
    found = D.out_of_order(lines, ["l_orderkey"], order, F.col("l_returnflag") == "R", F.col("l_returnflag") == "N")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query
def first_per_group(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return D.first_of_each(events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query
def extension_latest(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return D.latest_of_each(events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def _nations(spark, sf_dir):
    """Nations as callables, trade between them as calls, nations of region 0 as roots."""
    name = lambda c: F.concat(F.lit("n"), F.col(c))
    nation = read(spark, sf_dir, "nation")
    declarations = nation.select(F.lit("nations").alias("path"), F.lit("julia").alias("language"), name("n_nationkey").alias("name"), F.concat(F.lit("World."), name("n_nationkey")).alias("qualified_name"), F.lit("function").alias("kind"), F.col("n_nationkey").alias("line"))
    edges = _trade(spark, sf_dir).select(F.lit("julia").alias("language"), F.concat(F.lit("World."), name("source_nation")).alias("caller"), name("target_nation").alias("callee"))
    roots = nation.filter("n_regionkey = 0").select(F.lit("julia").alias("language"), name("n_nationkey").alias("declaration"))
    return declarations, edges, roots


@query
def call_reachability(spark, sf_dir):
    return G.reachable_names(*_nations(spark, sf_dir)).select("name")


@query
def unreachable(spark, sf_dir):
    return G.unreachable(*_nations(spark, sf_dir)).select("name", "qualified_name")


@query
def scc_groups(spark, sf_dir):
    _, edges, _ = _nations(spark, sf_dir)
    found = G.mutual_components(edges.select(S.terminal_name(F.col("caller")).alias("source"), F.col("callee").alias("target")))
    return found.select("component", F.array_join("members", ",").alias("members"), "size")


def _parties(spark, sf_dir):
    """Customers as callables; each calls the party whose key is that of the supplier of most of its line items; nation 0 has the roots."""
    name = lambda c: F.concat(F.lit("p"), F.col(c))
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    bought = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    per = bought.groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("n"))
    chosen = per.groupBy("o_custkey").agg(F.max_by("l_suppkey", F.struct("n", -F.col("l_suppkey"))).alias("s"))
    edges = chosen.select(F.lit("julia").alias("language"), F.concat(F.lit("Trade."), name("o_custkey")).alias("caller"), name("s").alias("callee"))
    declarations = customers.select(F.lit("parties").alias("path"), F.lit("julia").alias("language"), name("c_custkey").alias("name"), F.concat(F.lit("Trade."), name("c_custkey")).alias("qualified_name"), F.lit("function").alias("kind"), F.col("c_custkey").alias("line"))
    roots = customers.filter("c_nationkey = 0").select(F.lit("julia").alias("language"), name("c_custkey").alias("declaration"))
    return declarations, edges, roots


@query
def party_reachability(spark, sf_dir):
    return G.reachable_names(*_parties(spark, sf_dir)).select("name")


@query
def party_unreachable(spark, sf_dir):
    return G.unreachable(*_parties(spark, sf_dir)).select("name", "qualified_name")


@query
def party_cycles(spark, sf_dir):
    _, edges, _ = _parties(spark, sf_dir)
    found = G.mutual_components(edges.select(S.terminal_name(F.col("caller")).alias("source"), F.col("callee").alias("target")))
    return found.select("component", F.array_join("members", ",").alias("members"), "size")


@query
def root_union(spark, sf_dir):
    text = lambda c: F.col(c).cast("string")
    nation = read(spark, sf_dir, "nation")
    inferred = nation.filter("n_regionkey = 1").select(F.concat(F.lit("jet:"), F.col("n_name")).alias("id"), F.lit("src/a.jl").alias("path"), F.lit("julia").alias("language"), F.col("n_name").alias("declaration"), F.lit("production").alias("category"))
    declarations = nation.select(F.when(F.col("n_nationkey") % 4 == 0, "test/a.jl").otherwise("src/a.jl").alias("path"), F.lit("julia").alias("language"), F.when(F.col("n_nationkey") == 7, "main").otherwise(F.col("n_name")).alias("name"), F.concat(F.lit("World."), F.col("n_name")).alias("qualified_name"), F.lit("function").alias("kind"))
    signatures = read(spark, sf_dir, "supplier").select(F.lit("odin").alias("language"), F.lit("lib/a.odin").alias("path"), text("s_nationkey").alias("symbol"), F.when(F.col("s_suppkey") % 2 == 0, "export").otherwise("import").alias("direction"))
    entries = spark.createDataFrame([("entry", "julia", "World.FRANCE", "callback"), ("gone", "julia", "World.ATLANTIS", "callback")], "id string, language string, name string, category string")
    return G.call_roots(declarations, signatures, J.configured_roots(declarations, entries), inferred)


@query
def naming_violations(spark, sf_dir):
    names = read(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.col("p_name").alias("name")).unionByName(read(spark, sf_dir, "nation").select(F.lit("nation").alias("kind"), F.col("n_name").alias("name"))).unionByName(read(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name")))
    casing = [c for c in S.CASINGS if c != "any"]
    return names.groupBy("kind").agg(F.count("*").alias("names"), *(F.count_if(~S.valid_name(F.col("name"), c, ("FRANCE",), ("^Customer#00000001",))).alias(c) for c in casing))


@query
def abi_normalise(spark, sf_dir):
    kinds = ["Cint", "Cdouble", "Ptr{Cvoid}", "Ptr{ UInt8 }", "Cvoid", "MyType"]
    pick = F.element_at(F.array(*map(F.lit, kinds)), (F.col("p_partkey") % len(kinds)).cast("int") + 1)
    parts = read(spark, sf_dir, "part").select("p_partkey", pick.alias("declared"))
    return parts.select("p_partkey", "declared", S.abi_type(F.col("declared")).alias("type"), F.array_join(S.abi_returns(F.col("declared")), ",").alias("returns"))


RULES = [("COMMON-LINE-90", "common", "common", "Report", True), ("COMMON-LINE-100", "common", "common", "Warn", True), ("COMMON-LINE-120", "common", "common", "Fail", False), ("COMMON-NO-TABS", "common", "common", "Ignore", True), ("FR-ONLY", "fr", "french", "Warn", True), ("PT-ONLY", "pt", "none", "Warn", True)]
_RULE = "rule_id string, language string, engine string, response string, enabled boolean"


def _line_findings(spark, sf_dir):
    lines = L.lines_of(read(spark, sf_dir, "documents"), ["doc_id"]).select(F.col("doc_id").cast("string").alias("path"), "line", F.length("content").alias("width"))
    return L.width_findings(lines)


@query
def rule_remap(spark, sf_dir):
    rules = spark.createDataFrame(RULES, _RULE)
    found, _ = D.split_ignored(D.remap(_line_findings(spark, sf_dir), rules))
    return found.select("path", "line", "column", "rule_id", "response", "message", "measured", "allowed")


@query
def severity_matrix(spark, sf_dir):
    return D.severity_matrix(D.remap(_line_findings(spark, sf_dir), spark.createDataFrame(RULES, _RULE)))


@query
def limited_findings(spark, sf_dir):
    rows = _metrics(spark, sf_dir)
    renamed = rows.withColumn("rule_id", F.when(F.col("measured") >= 17, "ODIN-ALLOCATION-HEAP").otherwise(F.col("rule_id")))
    return D.display(renamed, 50)[0].select("path", "line", "column", "rule_id", "measured")


def _metrics(spark, sf_dir):
    """Orders as functions: line items as lines, distinct parts and the order's key as complexity."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("executable_lines"), F.countDistinct("l_partkey").alias("parts"))
    functions = lines.select(F.concat(F.lit("o"), F.col("l_orderkey")).alias("path"), F.when(F.col("l_orderkey") % 2 == 0, "julia").otherwise("odin").alias("language"), F.concat(F.lit("f"), F.col("l_orderkey") % 100).alias("name"), F.lit(1).alias("start_line"), "executable_lines", (F.col("parts") + F.col("l_orderkey") % 13).alias("cyclomatic"))
    tiers = {("julia", "lines"): (4, 6, 8), ("odin", "lines"): (3, 5, 7), ("julia", "cyclomatic"): (10, 13, 16), ("odin", "cyclomatic"): (10, 15, 18)}
    return D.metric_findings(functions, tiers)


@query
def metric_tiers(spark, sf_dir):
    return _metrics(spark, sf_dir).select("rule_id", "path", "line", "message", "measured", "allowed", "subject")


POLICIES = [
    ("one", 1, "JULIA-CYCLOMATIC-FAIL", "o10", "f10", 1, 1, "Report", "reviewed", "o10"),
    ("wide", 2, "ODIN-FUNCTION-LINES-FAIL", "o1", "f1", 1, 1, "Ignore", "reviewed", "o1"),
    ("stale", 3, "JULIA-CYCLOMATIC-FAIL", "nowhere", "f0", 1, 2, "Warn", "old", "nowhere"),
    ("twin-a", 4, "JULIA-FUNCTION-LINES-REPORT", "o2", "f2", 0, 9, "Warn", "a", "o2"),
    ("twin-b", 5, "JULIA-FUNCTION-LINES-REPORT", "o2", "f2", 0, 9, "Fail", "b", "o2"),
]
_POLICY = "policy_id string, ord int, rule_id string, path string, subject string, min_matches int, max_matches int, policy_response string, policy_reason string, policy_path string"


@query
def reviewed_policies(spark, sf_dir):
    policies = spark.createDataFrame(POLICIES, _POLICY)
    changed, drift = P.metric_policies(_metrics(spark, sf_dir), policies, ["rule_id", "path", "subject"])
    both = changed.filter("reviewed_policy_id is not null").unionByName(drift)
    return both.select("rule_id", "path", "line", "response", "message", "measured", "subject", "reviewed_policy_id", "reviewed_policy_reason")


@query
def rule_summary(spark, sf_dir):
    rules = spark.createDataFrame(RULES, _RULE)
    found, ignored = D.split_ignored(D.remap(_line_findings(spark, sf_dir), rules))
    files = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("lang").alias("language"))
    engines = spark.createDataFrame([("common", "complete"), ("french", "failed"), ("none", "not-applicable")], "name string, status string")
    code = D.exit_code(found, engines, "Warn")
    return D.rule_summary(rules, found, ignored, files, engines).join(code, F.lit(True))


@query
def engine_statuses(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    kinds = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "incomplete").when(F.col("event_type") == "view", "not-applicable").otherwise("complete")
    rows = events.select(F.concat(F.lit("u"), F.col("user_id")).alias("name"), kinds.alias("status"), F.when(F.col("event_type") == "error", F.concat(F.lit("e"), F.col("event_id"))).alias("message"), F.col("event_id").alias("ord"))
    return D.engine_statuses(rows)
