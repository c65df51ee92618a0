"""The rulebook around the operations: precedence, applicability, parameter layers, requirements, publication.

Rules, snapshots and parameter sets are small tables; they meet the cases by joins that Catalyst may broadcast when it
knows their size.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planlark.functions.checks import checked
from planlark.operators.verdict import DECISIVE, NO_APPLICABLE_RULE, NOT_FOUND, REVIEW_REQUIRED

LAYERS = {"GLOBAL": 0, "PROJECT": 1, "RUN": 2}


def engine_outcome(variant: Column, unconfirmed: Column, ambiguous: Column, unqualified: Column, missing: Column, mixed_units: Column, result: Column, on_missing: Column, on_ambiguous: Column) -> Column:
    """The fixed order in which a rule's case is decided; abstentions come before any verdict. E1."""
    return (
        F.when(variant.isNotNull(), variant)
        .when(unconfirmed, REVIEW_REQUIRED)
        .when(ambiguous, on_ambiguous)
        .when(unqualified, REVIEW_REQUIRED)
        .when(missing, on_missing)
        .when(mixed_units, REVIEW_REQUIRED)
        .otherwise(F.coalesce(result, F.lit(REVIEW_REQUIRED)))
    )


def derived(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Named derivations in order; each may use those before it. E2."""
    for name, value in steps:
        df = df.withColumn(name, value)
    return df


def version_key(version: Column) -> Column:
    """Sorts 1.10.0 after 1.9.0. E4."""
    return F.transform(F.split(version, r"\."), lambda x: x.cast("int"))


def latest_snapshots(snapshots: DataFrame, rule: str = "rule_id", version: str = "version") -> DataFrame:
    return snapshots.groupBy(rule).agg(*[F.max_by(c, version_key(F.col(version))).alias(c) for c in snapshots.columns if c != rule])


def applicability(cases: DataFrame, snapshots: DataFrame, discriminator: str) -> DataFrame:
    """cases (product_type, discriminator) with the rule that applies: a variant, else a global one; an unknown
    discriminator of a rule with variants has no rule, and a null one needs review. E3."""
    newest = latest_snapshots(snapshots)
    variants = newest.filter("variant IS NOT NULL").select("product_type", F.col("variant").alias("__v"), F.col("rule_id").alias("__vr"))
    kinds = newest.groupBy("product_type").agg(F.max(F.when(F.col("variant").isNull(), F.col("rule_id"))).alias("__g"), F.count_if(F.col("variant").isNotNull()).alias("__n"))
    both = cases.join(kinds, "product_type", "left").join(variants, (cases["product_type"] == variants["product_type"]) & (cases[discriminator] == F.col("__v")), "left").drop(variants["product_type"])
    rule = F.coalesce("__vr", "__g")
    state = F.when(F.coalesce("__n", F.lit(0)) == 0, F.when(F.col("__g").isNull(), NO_APPLICABLE_RULE)).when(F.col(discriminator).isNull(), REVIEW_REQUIRED).when(rule.isNull(), NO_APPLICABLE_RULE)
    return both.withColumns({"applies": F.when(state.isNull(), rule), "abstains": state}).drop("__v", "__vr", "__g", "__n")


def layered(parameters: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, value, layer, shadowed): the nearest layer wins; two values on one layer are an error. E5."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in LAYERS.items() for x in kv]), F.col("layer"))
    ranked = parameters.withColumn("__rank", rank)
    found = ranked.groupBy(*keys, "name").agg(
        F.max_by("value", "__rank").alias("value"),
        F.max_by("layer", "__rank").alias("layer"),
        F.array_sort(F.collect_list(F.struct("__rank", "layer", "value"))).alias("__all"),
        F.count("*").alias("__n"),
        F.count_distinct("__rank").alias("__layers"),
    )
    alone = checked(F.lit(True), F.col("__n") == F.col("__layers"), "two values on one layer")
    shadowed = F.transform(F.slice("__all", 1, F.size("__all") - 1), lambda x: F.concat_ws("=", x["layer"], x["value"].cast("string")))
    return found.filter(alone).select(*keys, "name", "value", "layer", F.array_join(shadowed, ",").alias("shadowed"))


def overrides(resolved: DataFrame, required: DataFrame, keys: list[str]) -> DataFrame:
    """What a layer above GLOBAL changed, and what is required but set nowhere. E6, Q11."""
    changed = resolved.filter("shadowed <> ''").select(*keys, "name", F.lit("overridden").alias("state"))
    unset = required.join(resolved, [*keys, "name"], "left_anti").select(*keys, "name", F.lit("outstanding").alias("state"))
    return changed.unionByName(unset)


def required_inputs(rules: DataFrame) -> DataFrame:
    """(input, cardinality, rules): who consumes what, from rules with inputs as map<name, cardinality>; one input in
    two cardinalities is an error. E7."""
    each = rules.select("rule_id", F.explode("inputs").alias("input", "cardinality"))
    found = each.groupBy("input").agg(F.min("cardinality").alias("cardinality"), F.max("cardinality").alias("__hi"), F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"))
    return found.filter(checked(F.lit(True), F.col("cardinality") == F.col("__hi"), "conflicting cardinality")).drop("__hi")


def every_variant(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """A decisive outcome only where all variants agree on it. E8."""
    one = F.when((F.min("outcome") == F.max("outcome")) & F.min("outcome").isin(*DECISIVE), F.min("outcome")).otherwise(REVIEW_REQUIRED)
    return outcomes.groupBy(*keys).agg(one.alias("outcome"), F.count("*").alias("variants"))


def publishable(parameters: DataFrame, keys: list[str]) -> DataFrame:
    """Blocked by an unconfirmed tolerance or an unset parameter. E9."""
    blocked = F.bool_or(~F.col("confirmed") | F.col("value").isNull())
    return parameters.groupBy(*keys).agg((~F.coalesce(blocked, F.lit(True))).alias("publishable"))


def snapshot_id(rule: dict) -> str:
    """SHA-256 of the rule's canonical JSON; rules are few, and this runs on the driver. E10."""
    return hashlib.sha256(json.dumps(rule, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def missing_outcome(value: Column, outcome: Column) -> Column:
    """NOT_FOUND where nothing was given, whatever the operation itself says."""
    return F.when(value.isNull(), NOT_FOUND).otherwise(outcome)


def outcome_counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    return findings.groupBy(*keys, "outcome").agg(F.count("*").alias("findings")).withColumn("share", F.round(F.col("findings") / F.sum("findings").over(Window.partitionBy(*keys)), 6))
