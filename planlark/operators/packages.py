"""The summary table of packages: one row per package at its current revision, in three orders, searched, in pages. Q3."""

from __future__ import annotations

import base64
import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from planlark.operators.relational import keyset_page

#: The columns of each order, and whether the largest come first. All end in the package, so they are total.
SORTS = {"updated": (["updated_at", "package"], True), "vendor": (["unnamed", "vendor_key", "package"], False), "needs_decision": (["blocking", "updated_at", "package"], True)}
#: What a finding may come to, and the name of its count.
OUTCOMES = {"PASS": "pass", "FAIL": "fail", "REVIEW_REQUIRED": "review", "NOT_FOUND": "not_found", "NO_APPLICABLE_RULE": "no_rule"}


def name_or_unnamed(vendor: Column) -> tuple[Column, Column]:
    """(unnamed, key): names go by themselves without case and outer blanks, the unnamed after all others. F13."""
    bare = F.lower(F.btrim(F.coalesce(vendor, F.lit(""))))
    return (bare == "").cast("int"), bare


def current_revisions(revisions: DataFrame) -> DataFrame:
    """Revisions (package, revision, number, created_at): the one of the greatest number of each package. W9."""
    return revisions.groupBy("package").agg(F.max_by(F.struct("revision", "number", "created_at"), F.struct("number", "revision")).alias("r")).select("package", "r.*")


def summaries(packages: DataFrame, revisions: DataFrame, events: DataFrame, checks: DataFrame, findings: DataFrame, approvals: DataFrame, exports: DataFrame) -> DataFrame:
    """One row per package with a revision.

    packages: package, vendor, product; events (of revisions): revision, sequence, id, at; checks: package, at; findings:
    finding, revision, outcome, superseded, blocking; approvals and exports: revision. ``updated_at`` is the newest state
    event's time, or the revision's own, or the newest check's if that is later. Each finding counts once however often it
    is joined, and not in a superseded run. Every side is reduced to a row a key before it is joined.
    """
    now = current_revisions(revisions)
    last = events.groupBy("revision").agg(F.max_by("at", F.struct("sequence", "id")).alias("state_at"))
    checked = checks.groupBy("package").agg(F.max("at").alias("checked_at"))
    live = findings.filter(~F.coalesce("superseded", F.lit(False))).groupBy("revision", "finding").agg(F.max("outcome").alias("outcome"), F.bool_or(F.coalesce("blocking", F.lit(False))).alias("blocking"))
    counts = live.groupBy("revision").agg(*[F.count_if(F.col("outcome") == k).alias(v) for k, v in OUTCOMES.items()], F.count_if("blocking").alias("blocking"))
    mark = lambda df, name: df.select("revision").distinct().withColumn(name, F.lit(True))
    both = packages.join(now, "package").join(last, "revision", "left").join(checked, "package", "left").join(counts, "revision", "left")
    both = both.join(mark(approvals, "approved"), "revision", "left").join(mark(exports, "signed_ready"), "revision", "left")
    unnamed, key = name_or_unnamed(F.col("vendor"))
    return both.select(
        "package", "revision", "number", "vendor", "product", F.greatest(F.coalesce("state_at", "created_at"), "checked_at").alias("updated_at"), unnamed.alias("unnamed"), key.alias("vendor_key"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in (*OUTCOMES.values(), "blocking")], *[F.coalesce(c, F.lit(False)).alias(c) for c in ("approved", "signed_ready")],
    )


def searched(rows: DataFrame, text: str | None, labels: dict[str, list[str]]) -> DataFrame:
    """Rows whose vendor holds the text, or whose product has a label that does, whatever the case; a blank text is no
    search. The text is literal: %, _ and \\ stand for themselves. F4."""
    needle = (text or "").strip().lower()
    if not needle:
        return rows
    products = [p for p, names in labels.items() if any(needle in n.lower() for n in names)]
    return rows.filter(F.contains(F.lower(F.coalesce("vendor", F.lit(""))), F.lit(needle)) | F.col("product").isin(products))


def _plain(value: object) -> object:
    return value.isoformat() if isinstance(value, datetime) else value


def cursor_of(row: Row, sort: str, text: str | None) -> str:
    """Where a page ended, good for this order and search alone."""
    key = [_plain(row[c]) for c in SORTS[sort][0]]
    return base64.urlsafe_b64encode(json.dumps([sort, (text or "").strip(), key]).encode()).decode()


def after(cursor: str, sort: str, text: str | None) -> tuple:
    try:
        was, searched_for, key = json.loads(base64.urlsafe_b64decode(cursor.encode()))
        parts = tuple(datetime.fromisoformat(v) if c == "updated_at" else v for c, v in zip(SORTS[sort][0], key, strict=True))
    except (ValueError, TypeError) as e:
        raise ValueError("not a cursor of this list") from e
    if (was, searched_for) != (sort, (text or "").strip()):
        raise ValueError("a cursor continues only the order and the search that it was issued for")
    return parts


def page(rows: DataFrame, sort: str, size: int, cursor: str | None = None, text: str | None = None, labels: dict[str, list[str]] | None = None) -> DataFrame:
    """The next ``size`` rows in the order, and one more where there is another page. F9, W7."""
    columns, down = SORTS[sort]
    return keyset_page(searched(rows, text, labels or {}), columns, None if cursor is None else after(cursor, sort, text), size, down)
