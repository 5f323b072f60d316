"""Reviewed policies: overrides of single findings with drift detection, one operator for all four kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.findings import diagnostics


def apply_policies(
    found: DataFrame,
    policies: DataFrame,
    key: list[str],
    condition: Column | None,
    equal: list[str],
    drift_rule: str,
    noun: str,
) -> tuple[DataFrame, DataFrame]:
    """Findings with overrides, and drift findings.

    ``policies``: ``policy_id, ord, min_matches, max_matches, policy_response, policy_reason, policy_path`` and selector
    columns; ``equal`` names columns that findings and policies share exactly, ``condition`` adds optional
    selectors.  ``key`` identifies a finding.  A finding with one match takes its response; with several it
    stays and drifts; every match counts for its policy, whose count must lie within its bounds.
    """
    side = policies.select(*(F.col(c).alias(f"p_{c}") for c in policies.columns))
    on = F.lit(True) if condition is None else condition
    for column in equal:
        on = on & (F.col(column) == F.col(f"p_{column}"))
    pairs = found.join(side, on).select(*key, *(f"p_{c}" for c in ("policy_id", "ord", "policy_response", "policy_reason")))
    per = pairs.groupBy(*key).agg(
        F.count("*").alias("matches"),
        F.min(F.struct("p_ord", "p_policy_id", "p_policy_response", "p_policy_reason")).alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_ord", "p_policy_id"))), lambda x: x["p_policy_id"]), ", ").alias("ids"),
    )
    joined = found.join(per, key, "left")
    one = F.col("matches") == 1
    changed = joined.select(
        *(c for c in found.columns if c not in ("response", "reviewed_policy_id", "reviewed_policy_reason")),
        F.when(one, F.col("first.p_policy_response")).otherwise(F.col("response")).alias("response"),
        F.when(one, F.col("first.p_policy_id")).otherwise(F.col("reviewed_policy_id")).alias("reviewed_policy_id"),
        F.when(one, F.col("first.p_policy_reason")).otherwise(F.col("reviewed_policy_reason")).alias("reviewed_policy_reason"),
    ).select(*found.columns)
    counts = pairs.groupBy(F.col("p_policy_id").alias("policy_id")).agg(F.count("*").alias("n"))
    stale = policies.join(counts, "policy_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n < min_matches or n > max_matches")
    drift = diagnostics(
        stale,
        rule_id=F.lit(drift_rule),
        response=F.lit("Fail"),
        path=F.col("policy_path"),
        line=F.lit(1),
        column=F.lit(1),
        message=F.format_string(f"Reviewed {noun} %s expected %d-%d matches, found %d.", "policy_id", "min_matches", "max_matches", "n"),
        measured=F.col("n"),
        source=F.lit("policy-drift"),
        subject=F.col("policy_id"),
    )
    several = joined.filter("matches > 1")
    ambiguous = diagnostics(
        several,
        rule_id=F.lit(drift_rule),
        response=F.lit("Fail"),
        path=F.col("path"),
        line=F.col("line"),
        column=F.col("column"),
        message=F.concat(F.lit("Finding matches multiple reviewed policies: "), F.col("ids"), F.lit(".")),
        measured=F.col("matches"),
        source=F.lit("policy-drift"),
        subject=F.col("subject"),
    )
    return changed, drift.unionByName(ambiguous)


def optional(expected: str, actual: str) -> Column:
    """A policy column that is null or equal."""
    return F.col(f"p_{expected}").isNull() | (F.col(f"p_{expected}") == F.col(actual))


def metric_policies(found: DataFrame, policies: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Function metrics: rule, path and function name."""
    return apply_policies(found, policies, key, None, ["rule_id", "path", "subject"], "FUNCTION-METRIC-POLICY-DRIFT", "complexity")


def naming_policies(found: DataFrame, policies: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Names: rule, path, kind and name."""
    return apply_policies(found, policies, key, None, ["rule_id", "path", "operation", "subject"], "NAMING-POLICY-DRIFT", "naming policy")


def clone_policies(found: DataFrame, policies: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Clones: rule and fingerprint, wherever they are."""
    return apply_policies(found, policies, key, None, ["rule_id", "subject"], "DUPLICATE-CODE-POLICY-DRIFT", "clone policy")


def allocation_policies(found: DataFrame, policies: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Allocations: path, procedure and rule exactly; operation, target, source and certainty if given."""
    on = optional("operation", "operation") & optional("allocation_target", "allocation_target") & optional("allocator_source", "allocator_source") & optional("certainty", "certainty")
    return apply_policies(found, policies, key, on, ["path", "procedure", "rule_id"], "ODIN-ALLOCATION-POLICY-DRIFT", "allocation policy")


def scanned(policies: DataFrame, files: DataFrame) -> DataFrame:
    """Policies whose path is among the scanned files."""
    return policies.join(files.select(F.col("path").alias("policy_path")).distinct(), "policy_path", "left_semi")
