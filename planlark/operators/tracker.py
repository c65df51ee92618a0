"""The items of a project over rounds and checks: where each stands, counts per round, and vendors' records. Q9.

Sightings have sid, package, answer, at, place, folded, round, page, status (different, check, same), compared, told (what
was stored about the round), decision, decided_at, decided_by; ``links`` gives each sid its item. Nothing leaves its package, so
everything is groups and windows inside one, which rows dealt by package need no other shuffle for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What may be stored about a finding's round, in older and newer words.
TOLD = {
    "fixed_in_later_round": "fixed",
    "fixed": "fixed",
    "still_wrong": "still_wrong",
    "new_in_later_round": "new",
    "new": "new",
    "not_in_later_round": "not_in_later_round",
    "single_round": "single_round",
    "now_right": "now_right",
    "still_not_compared": "still_not_compared",
}


#: The columns of an item.
ITEM = ["item", "package", "state", "open_kind", "fixed_round", "tags", "first_round", "round_now", "page", "ever_wrong", "checks_seen", "sightings", "decision", "decided_by", "first_seen", "last_seen"]


def told(word: Column) -> Column:
    """The word in its newer form; null for what is not known."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in TOLD.items() for x in kv]), word)


def is_open(status: str) -> Column:
    return F.col(status).isin("different", "check")


def per_round(sightings: DataFrame) -> DataFrame:
    """(item, package, round, status, told, page, next): the newest check's sighting of each round, its own finding before
    a folded page, and the item's next round. A ``same`` that was not compared says nothing and is left out."""
    counted = sightings.filter((F.col("status") != "same") | F.coalesce("compared", F.lit(True)))
    newest = F.max_by(F.struct("status", "told", "page"), F.struct("at", ~F.col("folded"), "answer", "place")).alias("s")
    rounds = counted.groupBy("item", "package", "round").agg(newest).select("item", "package", "round", "s.*")
    return rounds.withColumn("next", F.lead("round").over(Window.partitionBy("item").orderBy("round")))


def judged_rounds(sightings: DataFrame) -> DataFrame:
    """One row per item and round with what the item has come to by all its rounds (``state`` is null if it was never open); ``told``
    and ``status`` are those of the round's newest check, null where none counts, and ``first`` marks an item's first row.

    The latest round decides, unless the latest decision on any of its findings is that it is no problem. All of it is windows
    and groups inside a package, one after another, so rows that are dealt by package are not moved again."""
    is_counted = (F.col("status") != "same") | F.coalesce("compared", F.lit(True))
    fresh = F.row_number().over(Window.partitionBy("package", "item", "answer").orderBy("place")) == 1
    decided = F.when(F.col("decision").isNotNull(), F.struct("decided_at", "at", "answer", "place"))
    rows = sightings.withColumns({"__fresh": fresh, "__counted": is_counted})
    rows = rows.groupBy("package", "item", "round").agg(
        F.max_by(F.struct("status", "told", "page"), F.when(F.col("__counted"), F.struct("at", ~F.col("folded"), "answer", "place"))).alias("s"),
        F.max("__counted").alias("__counted"),
        F.max(is_open("status")).alias("__open"),
        F.max(F.col("status") == "different").alias("__wrong"),
        F.count_if("__fresh").alias("__checks"),
        F.count("*").alias("__n"),
        F.max(F.struct(decided.alias("at"), "decision", "decided_by")).alias("__decided"),
        F.coalesce(F.max(F.col("told") == "new"), F.lit(False)).alias("__new"),
        F.min("at").alias("__from"),
        F.max("at").alias("__to"),
    ).select("*", "s.*").drop("s")
    every = Window.partitionBy("package", "item").orderBy("round").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    later = Window.partitionBy("package", "item").orderBy("round").rowsBetween(1, Window.unboundedFollowing)
    of = lambda agg: agg.over(every)
    shown = F.when(F.col("__counted"), F.col("round"))
    rows = rows.withColumn("next", F.min(shown).over(later))
    wrong = F.when(is_open("status"), F.col("round"))
    rows = rows.withColumns({
        "first": F.row_number().over(Window.partitionBy("package", "item").orderBy("round")) == 1,
        "first_round": of(F.min("round")), "ever_wrong": of(F.max("__wrong")), "checks_seen": of(F.sum("__checks")), "sightings": of(F.sum("__n")), "__decided": of(F.max(F.when(F.col("__decided.at").isNotNull(), F.col("__decided")))),
        "__new": of(F.max("__new")), "first_seen": of(F.min("__from")), "last_seen": of(F.max("__to")), "__open": of(F.max("__open")), "round_now": of(F.max(shown)),
        "__last": of(F.max_by(F.struct("status", "told", "page"), shown)), "__wrong": of(F.max(wrong)), "__after": of(F.max_by(F.struct("next"), wrong))["next"], "__times": of(F.count_if(F.col("status") == "different")),
    })
    rows = rows.withColumn("__begins", F.min("round").over(Window.partitionBy("package").orderBy("round")))
    now, told_now = F.col("__last.status"), F.col("__last.told")
    fixed = F.when((now == "same") & (F.col("__wrong") < F.col("round_now")), F.col("__after")).when(now.isin("different", "check") & told_now.isin("fixed", "now_right"), F.col("round_now") + 1)
    state = F.when(F.col("__decided.decision") == "not_a_problem", "not_a_problem").when(fixed.isNotNull(), "fixed").when(now == "same", "right_later").otherwise("open")
    rows = rows.withColumn("state", F.when(F.col("__open"), state))
    still = F.col("state") == "open"
    tags = F.array(
        F.when((F.col("first_round") > 1) & ((F.col("first_round") > F.col("__begins")) | F.col("__new")), "New"),
        F.when(still & ((F.col("__times") >= 2) | F.coalesce(told_now == "still_wrong", F.lit(False))), "Previous comment not addressed"),
        F.when(still & (told_now == "still_not_compared"), "Still not compared"),
    )
    return rows.select(
        "package", "item", "round", "status", "first", "state", F.when(still, F.when(now == "different", "wrong").otherwise("decision")).alias("open_kind"), F.when(F.col("state") == "fixed", fixed).alias("fixed_round"),
        F.array_join(F.array_compact(tags), ", ").alias("tags"), "first_round", "round_now", F.col("__last.page").alias("page"), "ever_wrong", "checks_seen", "sightings", F.col("__decided.decision").alias("decision"), F.col("__decided.decided_by").alias("decided_by"), "first_seen", "last_seen",
    )


def items(sightings: DataFrame) -> DataFrame:
    """One row per item that was ever open: state (open, fixed, right_later, not_a_problem), open_kind, fixed_round, tags."""
    return judged_rounds(sightings).filter("first AND state IS NOT NULL").select(*ITEM)


def round_counts(sightings: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """(package, round, items, open, wrong, decision, fixed) of every round of a package. The items' states come from the
    sightings themselves, whether ``judged`` is given or not."""
    rows = judged_rounds(sightings)
    free = F.col("state") != "not_a_problem"
    one = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    shown = F.col("status").isNotNull() & F.col("state").isNotNull()
    parts = {"items": shown, "open": shown & is_open("status") & free, "wrong": shown & (F.col("status") == "different") & free, "decision": shown & (F.col("status") == "check") & free}
    none = {n: F.lit(0).cast("long").alias(n) for n in parts}
    seen = F.struct(F.col("round"), F.lit(True).alias("seen"), *[one(c).alias(n) for n, c in parts.items()], F.lit(0).cast("long").alias("fixed"))
    mended = F.struct(F.col("fixed_round").alias("round"), F.lit(False).alias("seen"), *none.values(), F.lit(1).cast("long").alias("fixed"))
    each = rows.select("package", F.inline(F.array_compact(F.array(seen, F.when(F.col("first") & F.col("fixed_round").isNotNull(), mended)))))
    counts = each.groupBy("package", "round").agg(F.max("seen").alias("seen"), *[F.sum(n).alias(n) for n in (*parts, "fixed")])
    return counts.filter("seen").drop("seen")


def vendor_records(sets: DataFrame, sightings: DataFrame, judged: DataFrame) -> DataFrame:
    """Per vendor (sets: package, vendor): items, mistakes, open ones, how often the next round had the mistake fixed, and
    the average number of open items a round."""
    mine = judged.join(sets, "package")
    mistake = F.col("ever_wrong") & ~F.col("state").isin("not_a_problem", "right_later")
    known = (F.col("status") == "different") & ((F.col("next") == F.col("round") + 1) | F.coalesce(F.col("told").isin("fixed", "still_wrong"), F.lit(False)))
    first = per_round(sightings).filter(known).groupBy("item").agg(F.min("round").alias("__first"))
    items_ = mine.join(first, "item", "left").groupBy("vendor").agg(
        F.count("*").alias("items"),
        F.count_if(mistake).alias("mistakes"),
        F.count_if(F.col("state") == "open").alias("open"),
        F.count_if(mistake & F.col("__first").isNotNull()).alias("fixed_next_of"),
        F.count_if(mistake & (F.col("fixed_round") == F.col("__first") + 1)).alias("fixed_next"),
    )
    rounds = round_counts(sightings, judged).join(sets, "package").groupBy("vendor").agg(F.count_distinct("package").alias("sets"), F.count("*").alias("rounds"), F.sum("open").alias("__open"))
    share = F.when(F.col("fixed_next_of") > 0, F.bround(F.lit(100) * F.col("fixed_next").cast("decimal(20,4)") / F.col("fixed_next_of"), 0).cast("long"))
    both = rounds.join(items_, "vendor", "left").fillna(0, ["items", "mistakes", "open", "fixed_next_of", "fixed_next"])
    return both.select("vendor", "sets", "rounds", "items", "mistakes", "open", "fixed_next", "fixed_next_of", share.alias("fixed_next_share"), F.bround(F.col("__open").cast("decimal(20,4)") / F.col("rounds"), 1).cast("double").alias("average_open"))
