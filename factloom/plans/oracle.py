"""DuckDB SQL for the registered queries, by query."""

from __future__ import annotations

FILES = """
files AS (
  SELECT doc_id, lang AS language, len(string_split(text, chr(10))) AS n, doc_id % 3 AS structs, n_chars % 7 + 1 AS cyclomatic FROM documents
), per AS (
  SELECT CASE WHEN grouping(language) = 1 THEN 'total' ELSE language END AS language, count(*) AS files, sum(n)::BIGINT AS lines, sum(structs)::BIGINT AS structs, sum(cyclomatic)::BIGINT AS complexity
  FROM files WHERE language IN ('en', 'de', 'fr', 'es') GROUP BY GROUPING SETS ((language), ())
)
"""

TRADE = """
trade AS (
  SELECT o_orderkey, c_nationkey AS source_nation, s_nationkey AS target_nation
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
)
"""

EDGES = TRADE + """, edges AS (
  SELECT DISTINCT 'n' || source_nation AS s, 'n' || target_nation AS t FROM trade
)
"""

PARTIES = """
edges AS (
  SELECT 'p' || o_custkey AS s, 'p' || arg_max(l_suppkey, n * 1000000000 - l_suppkey) AS t
  FROM (SELECT o_custkey, l_suppkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY o_custkey
), reached AS (
  SELECT 'p' || c_custkey AS name FROM customer WHERE c_nationkey = 0
  UNION SELECT t FROM reached JOIN edges ON s = name WHERE t IN (SELECT 'p' || c_custkey FROM customer)
)
"""

EVIDENCE = """
lines AS (
  SELECT l_orderkey AS id, l_linenumber AS line, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS c FROM lineitem GROUP BY ALL
), spans AS (
  SELECT id, count(*) AS instrumented, count(*) FILTER (c > 0) AS covered FROM lines WHERE line BETWEEN 1 AND 3 GROUP BY id
), base AS (
  SELECT o_orderkey AS id, o_orderkey::VARCHAR AS path, o_orderstatus AS language, 'f' || o_orderkey AS name, 1 AS start_line,
    CASE o_orderpriority WHEN '1-URGENT' THEN true WHEN '5-LOW' THEN NULL ELSE false END AS static_reachable,
    coalesce(instrumented, 0) AS runtime_instrumented_lines, coalesce(covered, 0) AS runtime_covered_lines, covered > 0 AS runtime_covered,
    CASE WHEN o_orderkey % 11 = 0 THEN 'bridge' ELSE '' END AS boundary_categories,
    (o_orderkey % 17 + 1 + ceil((o_custkey % 40 + 1) / 10.0) + CASE WHEN o_orderkey % 11 = 0 THEN 5 ELSE 0 END)::BIGINT AS risk_score
  FROM orders LEFT JOIN spans ON o_orderkey = spans.id
), evidence AS (
  SELECT *, CASE WHEN static_reachable AND runtime_covered THEN 'corroborated' WHEN static_reachable AND NOT runtime_covered THEN 'static-only'
    WHEN NOT static_reachable AND runtime_covered THEN 'runtime-only' WHEN NOT static_reachable AND NOT runtime_covered THEN 'uncovered'
    WHEN static_reachable IS NOT NULL THEN 'runtime-unavailable' WHEN runtime_covered IS NOT NULL THEN 'static-unavailable' ELSE 'unavailable' END AS evidence_class,
    coalesce(NOT static_reachable, false) OR coalesce(NOT runtime_covered, false) AS gap
  FROM base
)
"""

WIDTHS = """
found AS (
  SELECT path, line, width, CASE WHEN width > 120 THEN 120 WHEN width > 100 THEN 100 ELSE 90 END AS allowed
  FROM (SELECT doc_id::VARCHAR AS path, unnest(range(1, len(parts) + 1)) AS line, length(unnest(parts)) AS width FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
  WHERE width > 90
), named AS (
  SELECT *, 'COMMON-LINE-' || allowed AS rule_id, CASE allowed WHEN 120 THEN 'Line exceeds the hard 120-character limit.' WHEN 100 THEN 'Line exceeds the discouraged 100-character limit.' ELSE 'Line exceeds the 90-character warning threshold.' END AS message FROM found
), kept AS (
  SELECT *, CASE allowed WHEN 90 THEN 'Report' ELSE 'Warn' END AS response FROM named WHERE allowed < 120
)
"""

METRICS = """
fns AS (
  SELECT 'o' || l_orderkey AS path, CASE WHEN l_orderkey % 2 = 0 THEN 'julia' ELSE 'odin' END AS language, 'f' || (l_orderkey % 100) AS name, count(*) AS n, count(DISTINCT l_partkey) + l_orderkey % 13 AS cyclomatic
  FROM lineitem GROUP BY l_orderkey
), tiers(language, metric, r, w, f) AS (
  VALUES ('julia', 'lines', 4, 6, 8), ('odin', 'lines', 3, 5, 7), ('julia', 'cyclomatic', 10, 13, 16), ('odin', 'cyclomatic', 10, 15, 18)
), measured AS (
  SELECT path, language, name, 'lines' AS metric, n AS measured FROM fns UNION ALL SELECT path, language, name, 'cyclomatic', cyclomatic FROM fns
), metrics AS (
  SELECT upper(language) || CASE metric WHEN 'lines' THEN '-FUNCTION-LINES-' ELSE '-CYCLOMATIC-' END || tier AS rule_id, path, 1 AS line, 1 AS col, measured, CASE tier WHEN 'FAIL' THEN f WHEN 'WARN' THEN w ELSE r END AS allowed, name AS subject,
    CASE language WHEN 'odin' THEN 'Odin procedure' ELSE 'Julia function' END || ' `' || name || '` has ' || measured || CASE metric WHEN 'lines' THEN ' executable lines; ' ELSE ' cyclomatic complexity; ' END || lower(tier) || ' maximum is ' || CASE tier WHEN 'FAIL' THEN f WHEN 'WARN' THEN w ELSE r END || '.' AS message
  FROM (SELECT *, CASE WHEN measured > f THEN 'FAIL' WHEN measured > w THEN 'WARN' WHEN measured > r THEN 'REPORT' END AS tier FROM measured JOIN tiers USING (language, metric)) WHERE tier IS NOT NULL
)
"""

NAMES = """SELECT 'part' AS kind, p_name AS name FROM part UNION ALL SELECT 'nation', n_name FROM nation UNION ALL SELECT 'customer', c_name FROM customer"""


def _casing(name: str, pattern: str) -> str:
    return f"count(*) FILTER (NOT (CASE WHEN bare = '' THEN name = '_' ELSE regexp_matches(bare, '{pattern}') END OR name = 'FRANCE' OR starts_with(name, 'Customer#00000001'))) AS {name}"


_PASCAL, _SCREAM = "[A-Z][A-Za-z0-9]*", "[A-Z][A-Z0-9]*(_[A-Z0-9]+)*"
_CASINGS = ", ".join(
    _casing(*c)
    for c in (
        ("lowercase", "^[a-z][a-z0-9_]*$"),
        ("snake_case", "^[a-z][a-z0-9]*(_[a-z0-9]+)*$"),
        ("camel_case", f"^{_PASCAL}$"),
        ("camel_or_screaming", f"^({_PASCAL}|{_SCREAM})$"),
        ("ada_case", "^[A-Z][a-z0-9]*(_[A-Z][a-z0-9]*)*$"),
        ("screaming_snake_case", f"^{_SCREAM}$"),
    )
)

ORACLE_SQL: dict[str, str] = {
    "clone_groups": """
SELECT lang AS language, sha256(text) AS fingerprint, count(*) AS occurrences_n, max(len(string_split(text, ' '))) AS token_count, max(len(string_split(text, chr(10)))) AS executable_lines, min(doc_id) AS first_occurrence
FROM documents WHERE len(string_split(text, ' ')) >= 10 GROUP BY lang, text HAVING count(*) >= 2
""",
    "clone_members": """
SELECT lang AS language, sha256(text) AS fingerprint, doc_id AS occurrence FROM documents QUALIFY count(*) OVER (PARTITION BY lang, text) >= 2
""",
    "line_length_tiers": """
SELECT lang, CASE WHEN width > 120 THEN 'COMMON-LINE-120' WHEN width > 100 THEN 'COMMON-LINE-100' ELSE 'COMMON-LINE-90' END AS rule_id, count(*) AS findings, max(width) AS widest
FROM (SELECT lang, length(unnest(string_split(text, chr(10)))) AS width FROM documents) WHERE width > 90 GROUP BY ALL
""",
    "file_line_counts": """
WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS c FROM documents),
t AS (SELECT doc_id, lang, count(*) AS n, count(*) FILTER (trim(c) = '') AS b, count(*) FILTER (starts_with(c, '#')) AS k FROM l GROUP BY ALL),
u AS (SELECT t.*, CASE WHEN ends_with(text, chr(10)) OR text = '' THEN 1 ELSE 0 END AS d FROM t JOIN documents USING (doc_id))
SELECT doc_id::VARCHAR AS path, lang AS language, n - d AS physical_lines, n - b AS source_lines, n - b - k AS code_lines, k AS comment_lines, b - d AS blank_lines FROM u
""",
    "language_statistics": f"""
WITH {FILES}
SELECT language, files, lines AS physical_lines, lines AS source_lines, lines AS code_lines, 0 AS comment_lines, 0 AS blank_lines, structs AS struct_count, files AS functions, complexity, round(CASE WHEN lines > 0 THEN complexity / lines ELSE 0 END, 6) AS density FROM per
""",
    "effort_estimates": f"""
WITH {FILES}, c AS (
  SELECT language, lines AS n, 2.4 * pow(lines / 1000.0, 1.05) AS e, sqrt(CASE WHEN lines > 0 THEN complexity / lines ELSE 0 END) AS r FROM per
), m AS (
  SELECT *, 2.5 * pow(e, 0.38) AS s, 1 + 5 * r AS f, 1.5 + 2 * r AS k FROM c
)
SELECT language, round(e, 4) AS cocomo_effort, round(s, 4) AS cocomo_schedule, round(CASE WHEN s > 0 THEN e / s ELSE 0 END, 4) AS cocomo_people, round(e * (56286.0 / 12) * 2.4, 4) AS cocomo_cost,
  round(f, 4) AS locomo_factor, round(k, 4) AS locomo_cycles, round(n * 10 * k * 2 * f, 4) AS locomo_input_tokens, round(n * 10 * k, 4) AS locomo_output_tokens,
  round((n * 10 * k * 2 * f * 3 + n * 10 * k * 15) / 1e6, 4) AS locomo_cost, round(n * 10 * k / 50, 4) AS locomo_seconds, round(n * 0.01::DOUBLE / 60, 4) AS locomo_review_hours
FROM m
""",
    "files_by_language": """
SELECT w.language, count(doc_id) AS files FROM (VALUES ('en'), ('de'), ('fr'), ('es'), ('pt')) w(language) LEFT JOIN documents ON lang = w.language GROUP BY w.language
""",
    "unlabelled_documents": "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "orders_without_lines": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "layer_ownership": r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]*/([^?]*)', 1) AS path FROM pages),
l(prefix, layer, ord) AS (VALUES ('.', 'root', 0), ('en', 'english', 1), ('en/7', 'english-seven', 2), ('en/78', 'english-seventy-eight', 3), ('de', 'german', 4), ('fr', 'french', 5))
SELECT page_id, path, layer FROM p JOIN l ON prefix = '.' OR path = prefix OR starts_with(path, prefix || '/')
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(prefix) DESC, ord) = 1
""",
    "forbidden_dependency": f"""
WITH {TRADE}, r AS (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT o_orderkey, a.r_name AS source_layer, b.r_name AS target_layer FROM trade JOIN r a ON source_nation = a.n_nationkey JOIN r b ON target_nation = b.n_nationkey
WHERE a.r_name <> b.r_name AND (a.r_name, b.r_name) NOT IN (('ASIA', 'EUROPE'), ('EUROPE', 'ASIA'), ('AMERICA', 'ASIA'), ('AFRICA', 'EUROPE'))
""",
    "interop_pairing": """
WITH i AS (SELECT c_nationkey AS k, 'julia/' || c_custkey AS path, c_custkey % 10 = 0 AS lib, CASE WHEN c_custkey % 3 = 0 THEN 'i32' ELSE 'i64' END AS t FROM customer),
e AS (SELECT s_nationkey AS k, 'odin/' || s_suppkey AS path, CASE WHEN s_suppkey % 2 = 0 THEN 'i32' ELSE 'i64' END AS t, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier)
SELECT i.k::VARCHAR AS symbol, CASE WHEN e.k IS NULL THEN 'missing-odin' WHEN i.t = e.t THEN 'matched' ELSE 'signature-mismatch' END AS status, i.path AS julia_path, e.path AS odin_path, CASE WHEN i.t <> e.t THEN 'parameter types ' || i.t || ' != ' || e.t END AS mismatch
FROM i LEFT JOIN e ON i.k = e.k AND e.n = 1 WHERE NOT lib
UNION ALL SELECT k::VARCHAR, 'external', path, NULL, NULL FROM i WHERE lib
UNION ALL SELECT k::VARCHAR, 'missing-julia', NULL, path, NULL FROM e WHERE NOT (n = 1 AND k IN (SELECT k FROM i WHERE NOT lib))
""",
    "source_before_sink": """
WITH e AS (SELECT user_id, ts::DATE AS day, ts, event_id, event_type FROM events)
SELECT a.user_id, a.event_id AS source_id, b.event_id AS sink_id, coalesce(string_agg(c.event_id::VARCHAR, ',' ORDER BY c.event_id), '') AS sanitizers
FROM e a JOIN e b ON a.user_id = b.user_id AND a.day = b.day AND (a.ts, a.event_id) < (b.ts, b.event_id)
LEFT JOIN e c ON c.event_type = 'view' AND c.user_id = a.user_id AND c.day = a.day AND (c.ts, c.event_id) > (a.ts, a.event_id) AND (c.ts, c.event_id) < (b.ts, b.event_id)
WHERE a.event_type = 'signup' AND b.event_type = 'purchase' GROUP BY ALL
""",
    "contract_match": """
WITH c(id, ord, category, operation, source) AS (VALUES ('view-any', 1, 'view', NULL, NULL), ('click-one', 2, 'click', '1', NULL), ('click-two', 3, 'click', NULL, '2'), ('purchase', 4, 'purchase', '3', '0'), ('error-any', 5, 'error', NULL, NULL), ('error-zero', 6, 'error', '0', NULL)),
m AS (SELECT event_id, event_type, count(id) AS n, min(id) AS id, string_agg(id, ', ' ORDER BY ord) AS ids FROM events LEFT JOIN c ON category = event_type AND (operation IS NULL OR operation = (event_id % 4)::VARCHAR) AND (source IS NULL OR source = (user_id % 3)::VARCHAR) GROUP BY ALL)
SELECT event_id, event_type AS category, CASE WHEN n = 1 THEN id END AS contract_id, CASE WHEN n = 1 THEN 'caller' ELSE 'unknown' END AS ownership, CASE n WHEN 1 THEN 'complete' WHEN 0 THEN 'unresolved' ELSE 'ambiguous' END AS status,
CASE n WHEN 1 THEN 'reviewed ' || id WHEN 0 THEN 'No configured resource lifetime contract matched this allocation.' ELSE 'Multiple resource lifetime contracts matched: ' || ids || '.' END AS explanation FROM m
""",
    "coverage_range_join": f"""
WITH {EVIDENCE}
SELECT id, path, language, static_reachable, runtime_instrumented_lines, runtime_covered_lines, runtime_covered, evidence_class, boundary_categories, risk_score,
CASE evidence_class WHEN 'corroborated' THEN 'Static test reachability and runtime line coverage agree.' WHEN 'static-only' THEN 'Static test reachability was not corroborated at runtime.' WHEN 'runtime-only' THEN 'Runtime coverage exists outside the resolved test-call closure.'
WHEN 'uncovered' THEN 'Neither static test reachability nor runtime execution was observed.' WHEN 'runtime-unavailable' THEN 'No LCOV line intersects this declaration.' WHEN 'static-unavailable' THEN 'No static test root exists for this language.' ELSE 'Neither static test roots nor runtime lines are available.' END
|| ' Reachability and line execution do not prove assertion quality.' AS explanation FROM evidence
""",
    "coverage_counts": f"""
WITH {EVIDENCE}
SELECT CASE WHEN grouping(language) = 1 THEN 'total' ELSE language END AS language, count(*) AS declarations, count(*) FILTER (static_reachable) AS static_reachable, count(runtime_covered) AS instrumented, count(*) FILTER (runtime_covered) AS covered,
count(*) FILTER (evidence_class = 'corroborated') AS corroborated, count(*) FILTER (evidence_class = 'static-only') AS static_only, count(*) FILTER (evidence_class = 'runtime-only') AS runtime_only, count(*) FILTER (evidence_class = 'uncovered') AS uncovered,
count(*) FILTER (evidence_class = 'runtime-unavailable') AS runtime_unavailable, count(*) FILTER (evidence_class = 'static-unavailable') AS static_unavailable, count(*) FILTER (evidence_class = 'unavailable') AS unavailable, count(*) FILTER (gap) AS gaps
FROM evidence GROUP BY GROUPING SETS ((language), ())
""",
    "high_risk_topk": f"WITH {EVIDENCE} SELECT id, language, evidence_class, risk_score FROM evidence WHERE gap ORDER BY risk_score DESC, language, path, name, start_line::VARCHAR LIMIT 20",
    "narrowest_interval": """
WITH s AS (SELECT o_custkey AS path, datediff('day', DATE '1990-01-01', o_orderdate::DATE) AS a, o_orderkey AS scope, 10 + o_orderkey % 90 AS w FROM orders),
p AS (SELECT o_custkey AS path, datediff('day', DATE '1990-01-01', l_shipdate::DATE) AS at_, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT p.path || '/' || at_ AS point, lines, arg_min(scope, w * 100000000 + scope) AS scope FROM p LEFT JOIN s ON p.path = s.path AND at_ BETWEEN a AND a + w GROUP BY ALL
""",
    "heading_jump": """
WITH e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END AS level FROM events)
SELECT user_id, event_id, previous, level FROM (SELECT *, lag(level) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM e) WHERE level > previous + 1
""",
    "heading_count": "SELECT page_id, len(regexp_extract_all(html, '<h1')) AS headings, len(regexp_extract_all(html, '<h1')) <> 1 AS finding FROM pages",
    "relative_links": """
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS d FROM pages)
SELECT CASE WHEN starts_with(d, '#') THEN 'anchor' WHEN starts_with(d, '//') THEN 'network' WHEN starts_with(d, '/') THEN 'absolute' WHEN regexp_matches(lower(d), '^[a-z][a-z0-9+.-]*:') THEN 'scheme' ELSE 'relative' END AS kind, count(*) AS links, count(DISTINCT page_id) AS pages FROM l GROUP BY 1
""",
    "declaration_order": """
WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM d) WHERE seen = 1 AND l_returnflag = 'N'
""",
    "first_per_group": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "extension_latest": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "call_reachability": f"""
WITH RECURSIVE {EDGES}, reached AS (
  SELECT 'n' || n_nationkey AS name FROM nation WHERE n_regionkey = 0 UNION SELECT t FROM reached JOIN edges ON s = name
) SELECT name FROM reached
""",
    "unreachable": f"""
WITH RECURSIVE {EDGES}, reached AS (
  SELECT 'n' || n_nationkey AS name FROM nation WHERE n_regionkey = 0 UNION SELECT t FROM reached JOIN edges ON s = name
) SELECT 'n' || n_nationkey AS name, 'World.n' || n_nationkey AS qualified_name FROM nation WHERE 'n' || n_nationkey NOT IN (SELECT name FROM reached)
""",
    "scc_groups": f"""
WITH RECURSIVE {EDGES}, paths AS (
  SELECT s, t FROM edges WHERE s <> t UNION SELECT p.s, e.t FROM paths p JOIN edges e ON p.t = e.s WHERE e.s <> e.t
), mutual AS (
  SELECT a.s, a.t FROM paths a JOIN paths b ON a.s = b.t AND a.t = b.s WHERE a.s <> a.t
), groups AS (
  SELECT DISTINCT list_sort(list_distinct(list_append(list(t), s))) AS m FROM mutual GROUP BY s
) SELECT m[1] AS component, array_to_string(m, ',') AS members, len(m) AS size FROM groups
""",
    "party_reachability": f"WITH RECURSIVE {PARTIES} SELECT name FROM reached",
    "party_unreachable": f"""
WITH RECURSIVE {PARTIES}
SELECT 'p' || c_custkey AS name, 'Trade.p' || c_custkey AS qualified_name FROM customer WHERE 'p' || c_custkey NOT IN (SELECT name FROM reached)
""",
    "party_cycles": f"""
WITH RECURSIVE {PARTIES}, paths AS (
  SELECT s, t FROM edges WHERE s <> t UNION SELECT p.s, e.t FROM paths p JOIN edges e ON p.t = e.s WHERE e.s <> e.t
), cycles AS (
  SELECT DISTINCT list_sort(list_distinct(list_append(list(b.s), a.s))) AS m FROM paths a JOIN paths b ON a.s = b.t AND a.t = b.s WHERE a.s <> b.s GROUP BY a.s
) SELECT m[1] AS component, array_to_string(m, ',') AS members, len(m) AS size FROM cycles
""",
    "root_union": """
WITH d AS (SELECT CASE WHEN n_nationkey % 4 = 0 THEN 'test/a.jl' ELSE 'src/a.jl' END AS path, CASE WHEN n_nationkey = 7 THEN 'main' ELSE n_name END AS name, 'World.' || n_name AS q FROM nation)
SELECT 'test:' || q AS id, path, 'julia' AS language, name AS declaration, 'test' AS category FROM d WHERE starts_with(path, 'test/')
UNION SELECT 'main:julia:' || path, path, 'julia', name, 'production' FROM d WHERE name = 'main'
UNION SELECT 'bridge:' || s_nationkey || ':lib/a.odin', 'lib/a.odin', 'odin', s_nationkey::VARCHAR, 'bridge' FROM supplier WHERE s_suppkey % 2 = 0
UNION SELECT 'entry:' || path, path, 'julia', split_part(q, '.', 2), 'callback' FROM d WHERE q = 'World.FRANCE'
UNION SELECT 'jet:' || n_name, 'src/a.jl', 'julia', n_name, 'production' FROM nation WHERE n_regionkey = 1
""",
    "naming_violations": f"""
WITH n AS (SELECT *, regexp_replace(regexp_replace(name, '!$', ''), '^_+', '') AS bare FROM ({NAMES}))
SELECT kind, count(*) AS names, {_CASINGS} FROM n GROUP BY kind
""",
    "abi_normalise": """
WITH p AS (SELECT p_partkey, ['Cint', 'Cdouble', 'Ptr{Cvoid}', 'Ptr{ UInt8 }', 'Cvoid', 'MyType'][p_partkey % 6 + 1] AS declared FROM part)
SELECT p_partkey, declared, t AS type, CASE WHEN t = 'void' THEN '' ELSE t END AS returns
FROM (SELECT *, CASE declared WHEN 'Cint' THEN 'i32' WHEN 'Cdouble' THEN 'f64' WHEN 'Ptr{Cvoid}' THEN '^void' WHEN 'Ptr{ UInt8 }' THEN '^UInt8' WHEN 'Cvoid' THEN 'void' ELSE declared END AS t FROM p)
""",
    "rule_remap": f"WITH {WIDTHS} SELECT path, line, allowed + 1 AS \"column\", rule_id, response, message, width AS measured, allowed FROM kept",
    "severity_matrix": f"""
WITH {WIDTHS}
SELECT r.response, count(k.path) AS findings, count(DISTINCT k.path) AS files, count(DISTINCT k.rule_id) AS rules FROM (VALUES ('Report'), ('Warn'), ('Fail')) r(response) LEFT JOIN kept k ON k.response = r.response GROUP BY r.response
""",
    "limited_findings": f"""
WITH {METRICS}, m AS (SELECT path, line, col AS "column", CASE WHEN measured >= 17 THEN 'ODIN-ALLOCATION-HEAP' ELSE rule_id END AS rule_id, measured FROM metrics)
SELECT * FROM m WHERE rule_id = 'ODIN-ALLOCATION-HEAP' UNION ALL (SELECT * FROM m WHERE rule_id <> 'ODIN-ALLOCATION-HEAP' ORDER BY path, line, "column", rule_id LIMIT 50)
""",
    "metric_tiers": f"WITH {METRICS} SELECT rule_id, path, line, message, measured, allowed, subject FROM metrics",
    "reviewed_policies": f"""
WITH {METRICS}, pol(id, ord, rule_id, path, subject, lo, hi, response, reason, policy_path) AS (VALUES ('one', 1, 'JULIA-CYCLOMATIC-FAIL', 'o10', 'f10', 1, 1, 'Report', 'reviewed', 'o10'), ('wide', 2, 'ODIN-FUNCTION-LINES-FAIL', 'o1', 'f1', 1, 1, 'Ignore', 'reviewed', 'o1'),
  ('stale', 3, 'JULIA-CYCLOMATIC-FAIL', 'nowhere', 'f0', 1, 2, 'Warn', 'old', 'nowhere'), ('twin-a', 4, 'JULIA-FUNCTION-LINES-REPORT', 'o2', 'f2', 0, 9, 'Warn', 'a', 'o2'), ('twin-b', 5, 'JULIA-FUNCTION-LINES-REPORT', 'o2', 'f2', 0, 9, 'Fail', 'b', 'o2')),
pairs AS (SELECT m.*, p.id, p.ord, p.response, p.reason FROM metrics m JOIN pol p USING (rule_id, path, subject)),
per AS (SELECT rule_id, path, line, message, measured, subject, count(*) AS n, min(id) AS id, min(response) AS response, min(reason) AS reason, string_agg(id, ', ' ORDER BY ord) AS ids FROM pairs GROUP BY ALL),
counts AS (SELECT p.id, p.lo, p.hi, p.policy_path, count(x.id) AS n FROM pol p LEFT JOIN pairs x ON x.id = p.id GROUP BY ALL)
SELECT rule_id, path, line, response, message, measured, subject, id AS reviewed_policy_id, reason AS reviewed_policy_reason FROM per WHERE n = 1
UNION ALL SELECT 'FUNCTION-METRIC-POLICY-DRIFT', policy_path, 1, 'Fail', 'Reviewed complexity ' || id || ' expected ' || lo || '-' || hi || ' matches, found ' || n || '.', n, id, NULL, NULL FROM counts WHERE n < lo OR n > hi
UNION ALL SELECT 'FUNCTION-METRIC-POLICY-DRIFT', path, line, 'Fail', 'Finding matches multiple reviewed policies: ' || ids || '.', n, subject, NULL, NULL FROM per WHERE n > 1
""",
    "rule_summary": f"""
WITH {WIDTHS}, r(rule_id, language, engine, response, enabled) AS (VALUES ('COMMON-LINE-90', 'common', 'common', 'Report', true), ('COMMON-LINE-100', 'common', 'common', 'Warn', true), ('COMMON-LINE-120', 'common', 'common', 'Fail', false), ('COMMON-NO-TABS', 'common', 'common', 'Ignore', true), ('FR-ONLY', 'fr', 'french', 'Warn', true), ('PT-ONLY', 'pt', 'none', 'Warn', true))
SELECT rule_id, response, CASE WHEN NOT enabled THEN 'disabled' WHEN engine = 'french' THEN 'failed' WHEN engine = 'none' THEN 'not-applicable' ELSE 'evaluated' END AS status,
CASE WHEN enabled AND language = 'common' THEN (SELECT count(*) FROM documents) ELSE 0 END AS files_checked, (SELECT count(*) FROM kept k WHERE k.rule_id = r.rule_id) AS findings, 2 AS exit_code FROM r
""",
    "engine_statuses": """
WITH e AS (SELECT 'u' || user_id AS name, event_type, event_id FROM events)
SELECT name, CASE WHEN bool_or(event_type = 'error') THEN 'failed' WHEN bool_or(event_type = 'click') THEN 'incomplete' WHEN bool_and(event_type = 'view') THEN 'not-applicable' ELSE 'complete' END AS status,
coalesce(string_agg('e' || event_id, '; ' ORDER BY event_id) FILTER (event_type = 'error'), '') AS message FROM e GROUP BY name
""",
}
