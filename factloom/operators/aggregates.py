"""Counts and statistics over files, functions, clones and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.scalars import fingerprint, is_gap

LANGUAGES = ("julia", "odin", "markdown")
CLASSES = ("corroborated", "static-only", "runtime-only", "uncovered", "runtime-unavailable", "static-unavailable", "unavailable")


def files_by_language(files: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Files of each wanted language, zero where there are none."""
    wanted = files.sparkSession.createDataFrame([(x,) for x in languages], "language string")
    return wanted.join(files.groupBy("language").agg(F.count("*").alias("files")), "language", "left").select("language", F.coalesce("files", F.lit(0)).alias("files"))


def clone_groups(candidates: DataFrame, minimum: int = 2, min_tokens: int = 0, min_lines: int = 0) -> DataFrame:
    """Exact clones ``(language, fingerprint)`` of bodies that are large enough: group size and sorted occurrences.

    ``occurrence`` is any orderable column.  Bodies are compared by SHA-256; groups whose fingerprint stands
    for different bodies are dropped.  Small groups never reach the second step: occurrences are gathered only
    for fingerprints that are known to repeat.
    """
    able = candidates.filter((F.col("token_count") >= min_tokens) & (F.col("executable_lines") >= min_lines))
    rows = able.select("language", fingerprint(F.col("body")).alias("fingerprint"), "token_count", "executable_lines", "occurrence")
    return rows.groupBy("language", "fingerprint").agg(F.count("*").alias("occurrences_n"), F.max("token_count").alias("token_count"), F.max("executable_lines").alias("executable_lines"), F.min("occurrence").alias("first_occurrence")).filter(F.col("occurrences_n") >= minimum)


def clone_members(candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per occurrence of the groups; a hot group stays many rows and is never one array."""
    rows = candidates.select("language", fingerprint(F.col("body")).alias("fingerprint"), "occurrence")
    return rows.join(groups.select("language", "fingerprint"), ["language", "fingerprint"], "left_semi")


def _statistics() -> list[Column]:
    sums = [F.sum(c).cast("long").alias(c) for c in ("physical_lines", "source_lines", "code_lines", "comment_lines", "blank_lines", "struct_count")]
    return [F.count("*").alias("files"), *sums]


def code_statistics(files: DataFrame, functions: DataFrame, languages: tuple[str, ...] = ("julia", "odin")) -> DataFrame:
    """Totals and one row per language (``total`` for all): lines, structs, functions, complexity, density.

    Other languages don't count; wanted ones without files are zero.
    """
    code = files.filter(F.col("language").isin(*languages))
    sizes = code.groupBy("language").agg(*_statistics())
    calls = functions.filter(F.col("language").isin(*languages)).groupBy("language").agg(F.count("*").alias("functions"), F.sum("cyclomatic").cast("long").alias("complexity"))
    wanted = files.sparkSession.createDataFrame([(x,) for x in languages], "language string")
    names = ["files", "physical_lines", "source_lines", "code_lines", "comment_lines", "blank_lines", "struct_count", "functions", "complexity"]
    each = wanted.join(sizes, "language", "left").join(calls, "language", "left").select("language", *(F.coalesce(n, F.lit(0)).alias(n) for n in names))
    # a handful of rows: one per language
    total = each.rollup("language").agg(*(F.sum(n).alias(n) for n in names)).withColumn("language", F.coalesce("language", F.lit("total")))
    return total.withColumn("density", density(F.col("complexity"), F.col("code_lines")))


def density(complexity: Column, lines: Column) -> Column:
    return F.when(lines > 0, complexity / lines).otherwise(F.lit(0.0))


def cocomo(lines: Column) -> dict[str, Column]:
    """Effort in person months, schedule in months, people and cost of code lines."""
    effort = F.lit(2.4) * F.pow(lines / F.lit(1000.0), F.lit(1.05))
    schedule = F.lit(2.5) * F.pow(effort, F.lit(0.38))
    return {
        "effort": effort,
        "schedule": schedule,
        "people": F.when(schedule > 0, effort / schedule).otherwise(F.lit(0.0)),
        "cost": effort * F.lit(56286.0 / 12.0) * F.lit(2.4),
    }


def locomo(lines: Column, complexity: Column) -> dict[str, Column]:
    """Token, cost and time estimates of generating the code with a language model."""
    root = F.sqrt(density(complexity, lines))
    factor, cycles = F.lit(1.0) + F.lit(5.0) * root, F.lit(1.5) + F.lit(2.0) * root
    output = lines * F.lit(OUTPUT_TOKENS) * cycles
    given = output * F.lit(INPUT_RATIO) * factor
    return {
        "factor": factor,
        "cycles": cycles,
        "input_tokens": given,
        "output_tokens": output,
        "cost": (given * F.lit(INPUT_PRICE) + output * F.lit(OUTPUT_PRICE)) / F.lit(1e6),
        "seconds": output / F.lit(OUTPUT_SPEED),
        "review_hours": lines * F.lit(REVIEW_MINUTES) / F.lit(60.0),
    }


OUTPUT_TOKENS = 10.0
INPUT_RATIO = 2.0
INPUT_PRICE, OUTPUT_PRICE = 3.0, 15.0
OUTPUT_SPEED = 50.0
REVIEW_MINUTES = 0.01


def coverage_counts(evidence: DataFrame) -> DataFrame:
    """Twelve counts over declarations, overall (``total``) and by language."""
    counts = [
        F.count("*").alias("declarations"),
        F.count_if(F.col("static_reachable")).alias("static_reachable"),
        F.count_if(F.col("runtime_covered").isNotNull()).alias("instrumented"),
        F.count_if(F.col("runtime_covered")).alias("covered"),
        *(F.count_if(F.col("evidence_class") == c).alias(c.replace("-", "_")) for c in CLASSES),
        F.count_if(is_gap(F.col("static_reachable"), F.col("runtime_covered"))).alias("gaps"),
    ]
    marked = evidence.withColumn("language", F.coalesce("language", F.lit("")))
    return marked.rollup("language").agg(*counts).withColumn("language", F.coalesce("language", F.lit("total")))


def high_risk(evidence: DataFrame, limit: int) -> DataFrame:
    """The first gaps by risk; lines order as text."""
    gaps = evidence.filter(is_gap(F.col("static_reachable"), F.col("runtime_covered")))
    return gaps.orderBy(F.desc("risk_score"), "language", "path", "name", F.col("start_line").cast("string")).limit(limit)
