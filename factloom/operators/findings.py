"""Findings: metric tiers, rule remapping, ignored rows, display limits, summaries and the exit code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.scalars import RESPONSES, meets_threshold, response_rank

#: Canonical order of findings.
ORDER = ("path", "line", "column", "rule_id")
#: Packaged tiers: report, warn, fail by language and metric.
TIERS = {
    ("julia", "lines"): (20, 45, 65),
    ("odin", "lines"): (20, 45, 65),
    ("julia", "cyclomatic"): (10, 13, 16),
    ("odin", "cyclomatic"): (10, 15, 18),
}

DIAGNOSTIC = (
    "rule_id string, response string, path string, line long, column long, message string, measured long, allowed long, source string, "
    "subject string, operation string, allocator_source string, certainty string, procedure string, allocation_target string, "
    "reviewed_policy_id string, reviewed_policy_reason string"
)
_FIELDS = [f.strip().split(" ") for f in DIAGNOSTIC.split(",")]


def diagnostics(df: DataFrame, **columns: Column) -> DataFrame:
    """The 17 columns of findings; those not given are null, the response starts as Ignore."""
    columns = {"response": F.lit("Ignore"), **columns}
    return df.select(*(columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in _FIELDS))


def tier(measured: Column, report: Column, warn: Column, fail: Column) -> Column:
    """The highest tier exceeded, null if none."""
    return F.when(measured > fail, "FAIL").when(measured > warn, "WARN").when(measured > report, "REPORT")


def metric_findings(functions: DataFrame, tiers: dict[tuple[str, str], tuple[int, int, int]] = TIERS) -> DataFrame:
    """At most one finding per function and metric: the highest exceeded tier of body lines and of complexity."""
    rows = functions.select(
        "*",
        F.expr("stack(2, 'lines', executable_lines, 'cyclomatic', cyclomatic) as (metric, measured)"),
    )
    level, limit = F.lit(None).cast("string"), F.lit(None).cast("long")
    for (language, metric), (report, warn, fail) in tiers.items():
        here = (F.col("language") == language) & (F.col("metric") == metric)
        found = tier(F.col("measured"), F.lit(report), F.lit(warn), F.lit(fail))
        level = F.when(here, found).otherwise(level)
        limit = F.when(here, F.when(found == "FAIL", fail).when(found == "WARN", warn).otherwise(report)).otherwise(limit)
    rows = rows.withColumn("tier", level).withColumn("limit", limit).filter("tier is not null")
    lines = F.col("metric") == "lines"
    noun = F.when(F.col("language") == "odin", "procedure").otherwise("function")
    return diagnostics(
        rows,
        rule_id=F.concat(F.upper("language"), F.when(lines, "-FUNCTION-LINES-").otherwise("-CYCLOMATIC-"), F.col("tier")),
        path=F.col("path"),
        line=F.col("start_line"),
        column=F.lit(1),
        message=F.concat(F.initcap("language"), F.lit(" "), noun, F.lit(" `"), F.col("name"), F.lit("` has "), F.col("measured").cast("string"), F.when(lines, " executable lines; ").otherwise(" cyclomatic complexity; "), F.lower("tier"), F.lit(" maximum is "), F.col("limit").cast("string"), F.lit(".")),
        measured=F.col("measured"),
        allowed=F.col("limit"),
        source=F.lit("function-metrics"),
        subject=F.col("name"),
    )


def remap(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of enabled rules with the configured response; a rule without a row is an error in configuration.

    ``rules`` is ``(rule_id, response, enabled)``: one row per registered rule, so it is a small table.
    """
    enabled = rules.filter("enabled").select("rule_id", F.col("response").alias("configured"))
    return found.join(enabled, "rule_id").withColumn("response", F.col("configured")).drop("configured").select(*found.columns)


def split_ignored(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Visible findings, and counts of ignored ones by rule."""
    ignored = found.filter("response = 'Ignore'").groupBy("rule_id").agg(F.count("*").alias("ignored"))
    return found.filter("response <> 'Ignore'"), ignored


def is_allocation(rule_id: Column) -> Column:
    return rule_id.startswith("ODIN-ALLOCATION-")


def display(found: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows to show: all allocation findings and the first ``limit`` others; and how many are omitted.

    The first rows come from an ordered limit, not from a ranking of all rows in one task.
    """
    others = found.filter(~is_allocation(F.col("rule_id")))
    shown = found.filter(is_allocation(F.col("rule_id"))).unionByName(others.orderBy(*ORDER).limit(limit))
    omitted = others.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("omitted"))
    return shown.orderBy(*ORDER), omitted


def severity_matrix(found: DataFrame) -> DataFrame:
    """Findings, files and rules for each response, absent ones as zero."""
    counts = found.groupBy("response").agg(F.count("*").alias("findings"), F.countDistinct("path").alias("files"), F.countDistinct("rule_id").alias("rules"))
    wanted = found.sparkSession.createDataFrame([(r,) for r in RESPONSES[1:]], "response string")
    return wanted.join(counts, "response", "left").select("response", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("findings", "files", "rules")))


def exit_code(found: DataFrame, engines: DataFrame, threshold: str) -> DataFrame:
    """2 if an engine failed or is incomplete, else 1 if a visible finding reaches the threshold, else 0."""
    broken = engines.agg(F.coalesce(F.max(F.col("status").isin("failed", "incomplete").cast("int")), F.lit(0)).alias("broken"))
    reached = found.agg(F.coalesce(F.max(meets_threshold(F.col("response"), F.lit(threshold)).cast("int")), F.lit(0)).alias("reached"))
    # two single rows
    return broken.join(reached, F.lit(True)).select(F.when(F.col("broken") == 1, 2).otherwise(F.col("reached")).alias("exit_code"))


def engine_statuses(results: DataFrame) -> DataFrame:
    """One status per engine: failed over incomplete over not-applicable (all or none) over complete."""
    some = lambda s: F.coalesce(F.bool_or(F.col("status") == s), F.lit(False))
    every = F.coalesce(F.bool_and(F.col("status") == "not-applicable"), F.lit(True))
    status = F.when(some("failed"), "failed").when(some("incomplete"), "incomplete").when(every, "not-applicable").otherwise("complete")
    messages = F.array_sort(F.collect_list(F.when(F.col("message").isNotNull(), F.struct("ord", "message"))))
    return results.groupBy("name").agg(status.alias("status"), F.array_join(F.transform(messages, lambda m: m["message"]), "; ").alias("message"))


def rule_summary(rules: DataFrame, found: DataFrame, ignored: DataFrame, files: DataFrame, engines: DataFrame) -> DataFrame:
    """One row per rule ``(rule_id, language, engine, response, enabled)``: status, files checked, findings.

    A disabled rule is disabled, one whose engine failed is failed; a rule without files is not applicable.
    Files are counted for evaluated rules only; findings include ignored ones.
    """
    counted = found.groupBy("rule_id").agg(F.count("*").alias("seen")).join(ignored, "rule_id", "full")
    total = counted.select("rule_id", (F.coalesce("seen", F.lit(0)) + F.coalesce("ignored", F.lit(0))).alias("findings"))
    languages = files.filter("language is not null").groupBy("language").agg(F.count("*").alias("n"))
    every = files.agg(F.count("*").alias("all_files"))
    joined = rules.join(total, "rule_id", "left").join(languages, "language", "left").join(engines.select(F.col("name").alias("engine"), F.col("status").alias("engine_status")), "engine", "left").join(every, F.lit(True))
    checked = F.when(F.col("language") == "common", F.col("all_files")).otherwise(F.coalesce("n", F.lit(0)))
    status = (
        F.when(~F.col("enabled"), "disabled")
        .when(F.col("engine_status").isin("failed", "incomplete"), F.col("engine_status"))
        .when((checked == 0) | (F.col("engine_status") == "not-applicable"), "not-applicable")
        .otherwise("evaluated")
    )
    return joined.select("rule_id", "response", status.alias("status"), F.when(status == "evaluated", checked).otherwise(0).cast("long").alias("files_checked"), F.coalesce("findings", F.lit(0)).alias("findings"))


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by an order; pre-aggregated before the shuffle, so hot keys are no burden."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.min(F.struct(*order, *rest)).alias("_row") if not any(_unordered(df, c) for c in rest) else F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)


def latest_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by an order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def _unordered(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in ("map", "variant")


def jumps(df: DataFrame, group: list[str], order: list[str], level: str) -> DataFrame:
    """Rows whose level is more than one above the previous row's."""
    before = F.lag(level).over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("previous", before).filter(F.col(level) > F.col("previous") + 1)


def out_of_order(df: DataFrame, group: list[str], order: list[str], opens: Column, late: Column) -> DataFrame:
    """Rows that satisfy ``late`` although an earlier row of their group satisfies ``opens``."""
    frame = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_open", F.max(opens.cast("int")).over(frame)).filter(late & (F.col("_open") == 1)).drop("_open")
