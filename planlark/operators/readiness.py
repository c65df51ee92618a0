"""Whether packages can be signed off: what their results wait for, and what was recorded after their last live check. Q7.

Inputs come from many tables, keyed by package, by project, by page or by view (a view lies on one page, a page may belong to
several packages). Only the newest time counts, so the branches of one level are stacked and reduced to one row per key
before they meet the packages: one join a level, however many branches, and a page with many records sends one row.

Cases: a null key or time is no input; a package without a live check has no changed inputs (nor any results, which is
its reason); results of superseded checks do not count; a null outcome needs no one; a null flag is false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlark.operators.relational import stacked

#: Outcomes that wait for a person, those that are notes, how the reason of an unread value begins, and the
#: state in which a package can be signed.
BLOCKING, NOTES, WAITING, AWAITING = ("FAIL", "REVIEW_REQUIRED", "NOT_FOUND"), ("REVIEW_REQUIRED", "NOT_FOUND"), "Waiting for ", "AWAITING_REVIEW"
LEVELS = ("package", "project", "page", "view")


def branch(records: DataFrame, level: str, key: str, at: str, where: Column | None = None) -> tuple[str, DataFrame]:
    """One kind of input: its level, and (key, at) of the records that count."""
    if level not in LEVELS:
        raise ValueError(f"a branch is by {', '.join(LEVELS)}, not by {level}")
    rows = records if where is None else records.filter(where)
    return level, rows.select(F.col(key).alias("key"), F.col(at).alias("at")).dropna()


def last_inputs(branches: list[tuple[str, DataFrame]], packages: DataFrame, pages: DataFrame, views: DataFrame) -> DataFrame:
    """(package, at): the newest input of each package. packages: (package, project); pages: (page, package); views: (view, page)."""
    newest = {level: stacked(*found).groupBy("key").agg(F.max("at").alias("at")) for level in LEVELS if (found := [rows for own, rows in branches if own == level])}
    own = [newest["package"].withColumnRenamed("key", "package")] if "package" in newest else []
    if "project" in newest:
        own.append(packages.join(newest["project"].withColumnRenamed("key", "project"), "project").select("package", "at"))
    on_page = [newest["page"].withColumnRenamed("key", "page")] if "page" in newest else []
    if "view" in newest:
        on_page.append(views.join(newest["view"].withColumnRenamed("key", "view"), "view").select("page", "at"))
    if on_page:
        last = stacked(*on_page).groupBy("page").agg(F.max("at").alias("at"))
        own.append(pages.join(last, "page").select("package", "at"))
    return stacked(*own).groupBy("package").agg(F.max("at").alias("at"))


def result_states(results: DataFrame) -> DataFrame:
    """Results (outcome, reason, corrected, addressed) with their state: open, waiting for a value that no one has read, or
    settled; and ``rerun``, an open one that was corrected and waits for its check."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    unread = F.coalesce(F.col("outcome").isin(*NOTES) & F.col("reason").startswith(WAITING), F.lit(False))
    is_open = (F.coalesce(F.col("outcome").isin(*BLOCKING), F.lit(False)) | yes("corrected")) & ~yes("addressed")
    state = F.when(~is_open, "settled").when(unread & ~yes("corrected"), "waiting").otherwise("open")
    return results.withColumns({"state": state, "rerun": is_open & yes("corrected")})


def readiness(packages: DataFrame, checks: DataFrame, results: DataFrame, unchecked_pages: DataFrame, inputs: DataFrame) -> DataFrame:
    """(package, ready, reason, n_open, n_waiting, n_rerun): the first thing that keeps a package from being signed.

    packages: (package, state); checks: (check, package, at, superseded); results: (check, outcome, reason, corrected, addressed);
    unchecked_pages: (package, page); inputs: last_inputs().
    """
    live = checks.filter(~F.coalesce("superseded", F.lit(False)))
    of = lambda s: F.count_if(F.col("state") == s)
    # each check's results are counted before they meet the package
    counted = result_states(results).groupBy("check").agg(F.count("*").alias("n"), of("open").alias("n_open"), of("waiting").alias("n_waiting"), F.count_if("rerun").alias("n_rerun"))
    counts = ("n", "n_open", "n_waiting", "n_rerun")
    found = live.join(counted, "check", "left").groupBy("package").agg(F.max("at").alias("checked_at"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])
    pages = unchecked_pages.groupBy("package").agg(F.count_distinct("page").alias("n_pages"))
    both = packages.select("package", F.col("state").alias("stands")).join(found, "package", "left").join(pages, "package", "left").join(inputs.withColumnRenamed("at", "changed_at"), "package", "left")
    reason = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "no_results")
        .when(F.col("n_rerun") > 0, "corrected_wait_for_checks")
        .when(F.col("n_pages") > 0, "pages_unchecked")
        .when(F.col("changed_at") > F.col("checked_at"), "inputs_changed")
        .when(~F.col("stands").eqNullSafe(F.lit(AWAITING)), "not_awaiting_review")
    )
    return both.select("package", reason.isNull().alias("ready"), reason.alias("reason"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts[1:]])
