"""Facts that other programs make: native summaries, inference reports and build records, read as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.findings import diagnostics, first_of_each

VERSION = "3.10.0"
_FINDING = "array<struct<rule_id:string,line:long,column:long,message:string,procedure:string,operation:string,allocation_target:string,allocator_source:string,certainty:string>>"
SUMMARY = (
    "version string, files array<struct<path:string,parsed:boolean,errors:long,struct_count:long,"
    f"findings:{_FINDING},"
    "procedures:array<struct<name:string,start_line:long,end_line:long,parameter_count:long,return_count:long,cyclomatic:long,documented:boolean>>,"
    "calls:array<struct<caller:string,callee:string,kind:string,line:long,column:long>>,"
    "references:array<struct<name:string,scope:string,line:long,column:long>>>>"
)
BUILDS = "id string, input string, output string, command array<string>, flags array<string>, status string, exit_code long, stdout string, stderr string"
INFERENCE = "path string, line long, column long, message string, ord long"


def native_summaries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per file of native summaries; another version of the protocol is an error."""
    raw = spark.read.schema(SUMMARY).json(path, multiLine=True)
    checked = raw.withColumn("version", F.when(F.col("version") == VERSION, F.col("version")).otherwise(F.raise_error(F.concat(F.lit("native facts have version "), F.coalesce("version", F.lit("none"))))))
    return checked.select("version", F.inline("files")).filter("version is not null").drop("version")


def native_calls(files: DataFrame) -> DataFrame:
    """Call edges of native summaries; an empty caller is none."""
    rows = files.select(F.col("path").alias("source_path"), F.inline("calls"))
    return rows.select("source_path", F.lit("odin").alias("language"), F.nullif("caller", F.lit("")).alias("caller"), "callee", "kind", "line", "column")


def native_allocations(files: DataFrame) -> DataFrame:
    """Raw allocation events, before any rule is applied."""
    rows = files.select("path", F.inline("findings")).filter("rule_id like 'ODIN-ALLOCATION-%'")
    empty = lambda c: F.nullif(c, F.lit("")).alias(c)
    return rows.select("path", "rule_id", "line", "column", *map(empty, ("procedure", "operation", "allocation_target", "allocator_source", "certainty")))


def syntax_findings(files: DataFrame) -> DataFrame:
    bad = files.filter("not parsed or errors > 0")
    return diagnostics(bad, rule_id=F.lit("ODIN-SYNTAX"), path=F.col("path"), line=F.lit(1), column=F.lit(1), message=F.lit("Odin source could not be parsed."), measured=F.col("errors"), allowed=F.lit(0), source=F.lit("odin-ast"))


def inference_findings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Reports of static inference, the first of each position and message."""
    rows = first_of_each(spark.read.schema(INFERENCE).json(path), ["path", "line", "column", "message"], ["ord"])
    return diagnostics(rows, rule_id=F.lit("JULIA-JET-POSSIBLE-ERROR"), path=F.col("path"), line=F.col("line"), column=F.col("column"), message=F.col("message"), source=F.lit("jet"), certainty=F.lit("potential"))


def build_findings(builds: DataFrame) -> DataFrame:
    """Builds that ended with an error."""
    return diagnostics(builds.filter("exit_code <> 0"), rule_id=F.lit("ODIN-BUILD-FAILED"), path=F.col("input"), line=F.lit(1), column=F.lit(1), message=F.concat(F.lit("Build target `"), F.col("id"), F.lit("` failed.")), measured=F.col("exit_code"), allowed=F.lit(0), source=F.lit("odin-build"), subject=F.col("id"))


def read_builds(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema(BUILDS).json(path)
