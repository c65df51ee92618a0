"""Quality metrics: exact numerators and denominators, null where nothing was measured, and comparisons of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planlark.operators.relational import ratio

#: Metrics in report order, and whether more is better.
METRICS = {
    "critical_false_pass_rate": False,
    "localisation_rate": True,
    "numeric_accuracy": True,
    "unit_accuracy": True,
    "identifier_precision": True,
    "fail_recall": True,
    "abstention_recall": True,
    "automation_coverage": True,
}


def conditional(name: str, of: Column, among: Column) -> list[Column]:
    """The two counts of a ratio: rows of ``among``, and those of them that are ``of``."""
    return [F.count_if(among & of).alias(f"{name}__num"), F.count_if(among).alias(f"{name}__den")]


def finding_metrics(findings: DataFrame) -> DataFrame:
    """findings: severity, expected, outcome. One row per metric: name, num, den, value. M1, M5, M6, M7."""
    expected, got = F.col("expected"), F.col("outcome")
    decided = got.isin("PASS", "FAIL")
    row = findings.agg(
        *conditional("critical_false_pass_rate", got == "PASS", (F.col("severity") == "CRITICAL") & (expected == "FAIL")),
        *conditional("fail_recall", got == "FAIL", expected == "FAIL"),
        *conditional("abstention_recall", ~decided, ~expected.isin("PASS", "FAIL")),
        *conditional("automation_coverage", decided, F.lit(True)),
    )
    return unpivoted(row, ["critical_false_pass_rate", "fail_recall", "abstention_recall", "automation_coverage"])


def unpivoted(row: DataFrame, names: list[str]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"{n}__num").alias("num"), F.col(f"{n}__den").alias("den")) for n in names])
    return row.select(F.inline(each)).withColumn("value", ratio(F.col("num"), F.col("den")))


def reading_metrics(gold: DataFrame, read: DataFrame, keys: list[str]) -> DataFrame:
    """gold, read: keys, value, unit. Denominators are the gold's rows. M3."""
    both = gold.join(read.withColumnsRenamed({"value": "__v", "unit": "__u"}), keys, "left")
    right = F.coalesce(F.col("value") == F.col("__v"), F.lit(False))
    row = both.agg(*conditional("numeric_accuracy", right, F.lit(True)), *conditional("unit_accuracy", F.coalesce(F.col("unit") == F.col("__u"), F.lit(False)), F.lit(True)))
    return unpivoted(row, ["numeric_accuracy", "unit_accuracy"])


def match_precision(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """The denominator is what was predicted. M4."""
    right = predicted.join(gold.select(*keys).distinct().withColumn("__g", F.lit(True)), keys, "left")
    return unpivoted(right.agg(*conditional("identifier_precision", F.coalesce("__g", F.lit(False)), F.lit(True))), ["identifier_precision"])


def localisation(pairs: DataFrame, percent: int) -> DataFrame:
    """pairs: common, joined (areas), same_page; a row with ``n`` is n pairs. IoU >= percent / 100, compared as integers. M2, A16."""
    good = F.col("same_page") & (F.col("common") * 100 >= F.col("joined") * percent)
    counts = [F.coalesce(F.sum(F.when(c, number_of(pairs))), F.lit(0)).alias(f"localisation_rate__{k}") for k, c in (("num", good), ("den", F.lit(True)))]
    return unpivoted(pairs.agg(*counts), ["localisation_rate"])


def number_of(pairs: DataFrame) -> Column:
    return F.col("n") if "n" in pairs.columns else F.lit(1).cast("long")


def mean_iou(pairs: DataFrame) -> DataFrame:
    """(metric, pairs, value): the mean of common / joined over pairs that have an area; a row with ``n`` is n pairs. A16."""
    n = number_of(pairs)
    share = F.try_divide("common", "joined")
    mean = F.try_divide(F.sum(share * n), F.sum(F.when(share.isNotNull(), n)))
    return pairs.agg(F.lit("mean_iou").alias("metric"), F.coalesce(F.sum(n), F.lit(0)).alias("pairs"), F.round(mean, 6).alias("value"))


def metric_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """better, worse, same; a lost measurement is worse, a new one better. M8."""
    a, b = before.select("metric", F.col("value").alias("was")), after.select("metric", F.col("value").alias("now"))
    both = a.join(b, "metric", "full_outer")
    up = F.element_at(F.create_map(*[F.lit(x) for kv in METRICS.items() for x in kv]), F.col("metric"))
    change = F.col("now") - F.col("was")
    state = (
        F.when(F.col("was").isNull() & F.col("now").isNull(), "unmeasured")
        .when(F.col("now").isNull(), "lost")
        .when(F.col("was").isNull(), "gained")
        .when(change == 0, "same")
        .when((change > 0) == F.coalesce(up, F.lit(True)), "better")
        .otherwise("worse")
    )
    return both.select("metric", "was", "now", F.round(change, 6).alias("change"), state.alias("state"))


def case_delta(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Newly right and newly wrong on the cases that both runs have. M9."""
    a, b = (df.select(*keys, (F.col("outcome") == F.col("expected")).alias(name)) for df, name in ((before, "was"), (after, "now")))
    return a.join(b, keys).filter("was <> now").select(*keys, F.when(F.col("now"), "newly_right").otherwise("newly_wrong").alias("change"))


def release_gates(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """thresholds: metric, least, most. An unmeasured metric blocks. M10."""
    both = thresholds.join(metrics.select("metric", "value"), "metric", "left")
    state = F.when(F.col("value").isNull(), "NOT_MEASURED").when(F.col("least").isNotNull() & (F.col("value") < F.col("least")), "BLOCKED").when(F.col("most").isNotNull() & (F.col("value") > F.col("most")), "BLOCKED").otherwise("OK")
    return both.select("metric", "value", state.alias("gate"))


def scorecard_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """fixed, broke, new_wrong, moved, dropped, same by case: keys, answer, right. M11."""
    a = before.select(*keys, F.col("answer").alias("a"), F.col("right").alias("ar"))
    b = after.select(*keys, F.col("answer").alias("b"), F.col("right").alias("br"))
    both = a.join(b, keys, "full_outer")
    state = F.when(F.col("br").isNull(), "dropped").when(F.col("ar").isNull(), F.when(F.col("br"), "new_right").otherwise("new_wrong")).when(~F.col("ar") & F.col("br"), "fixed").when(F.col("ar") & ~F.col("br"), "broke").when(~F.col("a").eqNullSafe(F.col("b")), "moved").otherwise("same")
    return both.select(*keys, state.alias("state"))


def reader_state(answer: Column, key: Column, valid: Column) -> Column:
    """M12."""
    return F.when(~valid, "invalid").when(answer.isNull(), "unsure").when(answer == key, "right").otherwise("wrong")


def pair_state(a: Column, b: Column) -> Column:
    return F.when((a == "right") & (b == "right"), "both_right").when((a == "wrong") & (b == "wrong"), "both_wrong").when((a == "right") | (b == "right"), "one_right").otherwise("none_right")


def multiset_match(gold: DataFrame, read: DataFrame, page: str, value: str) -> DataFrame:
    """Readings against gold by (page, value), each once: usable readings first, then held ones. M13."""
    g = gold.withColumn("__k", F.row_number().over(Window.partitionBy(page, value).orderBy("id"))).select(page, value, "__k", F.lit(True).alias("__g"))
    r = read.withColumn("__k", F.row_number().over(Window.partitionBy(page, value).orderBy("held", "id"))).select(page, value, "__k", "held")
    both = g.join(r, [page, value, "__k"], "full_outer")
    state = F.when(F.col("__g").isNull(), "extra").when(F.col("held").isNull(), "missing").when(F.col("held"), "held").otherwise("found")
    return both.groupBy(page).agg(*[F.count_if(state == s).alias(s) for s in ("found", "held", "missing", "extra")])


def scorecard(gold: DataFrame, read: DataFrame, package: str, key: str) -> DataFrame:
    """(package, accuracy over attempted, coverage over all). M14."""
    both = gold.join(read.select(package, key, F.col("value").alias("__v")), [package, key], "left")
    tried = F.col("__v").isNotNull()
    return both.groupBy(package).agg(ratio(F.count_if(tried & (F.col("__v") == F.col("value"))), F.count_if(tried)).alias("accuracy"), ratio(F.count_if(tried), F.count("*")).alias("coverage"))


def correction_rate(reviewed: DataFrame, keys: list[str], item: str, corrected: Column) -> DataFrame:
    """Distinct corrected over distinct reviewed. M15, A19."""
    n, c = F.count_distinct(item), F.count_distinct(F.when(corrected, F.col(item)))
    return reviewed.groupBy(*keys).agg(n.alias("reviewed"), c.alias("corrected"), ratio(c, n).alias("rate"))


def may_decide(records: DataFrame, kind: str, wrong: Column, least: int = 30) -> DataFrame:
    """Kinds of check that were clean on enough keyed cases. M16."""
    return records.groupBy(kind).agg(F.count("*").alias("cases"), F.count_if(wrong).alias("wrong")).withColumn("may_decide", (F.col("cases") >= least) & (F.col("wrong") == 0))
