"""Mixing to target weights with soft domain membership.

A labelled table trains a Gaussian classifier over a few character statistics; it predicts each document's posterior
over domains. With n tokens and posterior p, a document at rate r counts n * r * p in expectation. Projected gradient
steps fit rates r >= floor so that the domains' expected totals match their targets, staying near 1.

The least squares: with A r the totals, t the targets and M = sum of n p p' (the domains' Gram matrix), the objective is
(A r - t)' M^-1 (A r - t) / 2. Rates are measured by the inner product sum of n r s, which is diagonal, so clipping at the
floor is the projection in it. There the gradient of a document is p . M^-1 (A r - t), and A M^-1 A' is the identity, so
the gradient has Lipschitz constant 1: steps of length 1 never raise the objective and converge to its least value over
the bounds, whichever of them bind. Each step reads (doc_id, n, p) and sums one number a domain; only those numbers come
to the driver. Steps end when the targets are reached, when the objective hardly falls (then the targets are out of
reach), or after ``steps`` of them; what remains of each target is in the result (``domain_error``) in every case.

Everything is built-in functions. Rates are folded into one expression over the steps so far, and written every
FOLD steps, so the plan stays short.

Sizes: the classifier takes at most ``max_rows`` labelled documents (those of smallest hash); of more than MAX_DOMAINS
domains the rarer ones (ties by name) are one domain, ``other``.

Cases: a null or empty text has no tokens, the priors as posterior, and rate 1 or what its domain needs; null labels
are left out; a labelled doc_id of several languages takes the first by name; with no labelled rows there is one domain
and every rate is the same; repeated rows are fitted each; very long texts count in full; further columns are ignored;
an empty table gives no rows. A domain without any expected token cannot reach a positive target: its error is left.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planlark.functions.rational import let
from planlark.llm.common import written

MAX_DOMAINS, FOLD = 64, 6
#: Classes of characters whose share tells languages and junk apart.
CLASSES = ("[äöüßÄÖÜ]", "[éèêçàâîôûœÉÈÊÇÀ]", "[ñóíáúÑÓÍÁÚ¿¡]", "[#%&*$|@<>]", "[0-9]")
N_FEATURES = len(CLASSES) + 2


def features(text: Column) -> list[Column]:
    """Numbers of order 1: logarithms of characters per thousand, of the length in words, and the mean word length."""
    size = F.greatest(F.length(text), F.lit(1))
    shares = [F.log1p(F.regexp_count(text, F.lit(c)) * 1000.0 / size) for c in CLASSES]
    return [*shares, F.log1p(tokens(text)), F.log1p(size / F.greatest(tokens(text), F.lit(1)))]


def tokens(text: Column) -> Column:
    """Words between spaces, tabs and line ends."""
    return F.regexp_count(text, F.lit(r"[^\x20\t\r\n]+")).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, n, x): tokens and features of each document."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", tokens(text).alias("n"), F.array(*features(text)).alias("x"))


def labelled_domains(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, domain): language and quality of labelled documents, at most max_rows."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    named = docs.select("doc_id", "lang").join(F.broadcast(few), "doc_id").filter("lang IS NOT NULL")
    return named.select("doc_id", F.concat_ws("/", "lang", "quality").alias("domain"))


def classifier(measures: DataFrame, domains: DataFrame) -> list[tuple[str, float, list[float], list[float]]]:
    """(domain, log prior, means, variances), by name."""
    named = domains.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    both = measures.join(F.broadcast(named), "doc_id").filter("n > 0")
    stats = [f(F.col("x")[k]).alias(f"{name}{k}") for k in range(N_FEATURES) for name, f in (("m", F.avg), ("v", F.var_pop))]
    every = both.groupBy("domain").agg(F.count("*").alias("rows"))
    kept = [r["domain"] for r in every.orderBy(F.desc("rows"), "domain").limit(MAX_DOMAINS + 1).collect()]
    if len(kept) > MAX_DOMAINS:
        both = both.withColumn("domain", F.when(F.col("domain").isin(kept[: MAX_DOMAINS - 1]), F.col("domain")).otherwise(F.lit("other")))
    rows = both.groupBy("domain").agg(F.count("*").alias("rows"), *stats).orderBy("domain").collect()
    total = sum(r["rows"] for r in rows)
    return [(r["domain"], math.log(r["rows"] / total), [r[f"m{k}"] for k in range(N_FEATURES)], [r[f"v{k}"] + 0.05 for k in range(N_FEATURES)]) for r in rows]


def posterior(model) -> Column:
    """array<double>: the posterior over the model's domains."""
    if not model:
        return F.array(F.lit(1.0))

    def log_joint(prior, means, variances):
        terms = [F.lit(prior - 0.5 * sum(map(math.log, variances)))]
        return sum((-(F.col("x")[k] - m) * (F.col("x")[k] - m) / (2 * v) for k, (m, v) in enumerate(zip(means, variances, strict=True))), terms[0])

    logs = F.array(*[F.when(F.col("n") > 0, log_joint(p, m, v)).otherwise(F.lit(p)) for _, p, m, v in model])
    shifted = let(logs, lambda a: let(F.array_max(a), lambda top: F.transform(a, lambda s: F.exp(s - top))))
    return let(shifted, lambda a: let(F.aggregate(a, F.lit(0.0), lambda t, e: t + e), lambda t: F.transform(a, lambda e: e / t)))


def soft_members(docs: DataFrame, domains: DataFrame) -> tuple[DataFrame, list[str]]:
    """(doc_id, n, p) of each document, and the domains' names."""
    measures = written(measured(docs), "measures")
    model = classifier(measures, domains)
    joint = measures.select("doc_id", "n", posterior(model).alias("p"))
    return written(joint, "members"), [m[0] for m in model] or ["all"]


def fit_rates(members: DataFrame, targets: list[float], floor: float = 0.0, steps: int = 40, within: float = 1e-6, stall: float = 1e-3) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, p, rate), and the totals reached. targets: expected tokens of each domain.

    Steps end when all totals are ``within`` that share of their sum, or when one takes less than the part ``stall`` off
    the objective."""
    k = len(targets)
    p = [F.col("p")[i] for i in range(k)]
    gram = members.agg(*[F.sum(F.col("n") * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    matrix = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            matrix[i, j] = matrix[j, i] = gram[f"g{i}_{j}"] or 0.0
    matrix += np.eye(k) * max(1e-9 * np.trace(matrix), 1e-9)
    goal = np.array(targets, dtype=float)
    base, rate, reached, loss = members.withColumn("rate", F.lit(1.0)), F.col("rate"), goal, np.inf
    for step in range(steps + 1):
        row = base.agg(*[F.sum(F.col("n") * p[i] * rate).alias(f"s{i}") for i in range(k)]).first()
        reached = np.array([row[f"s{i}"] or 0.0 for i in range(k)])
        z, before = np.linalg.solve(matrix, reached - goal), loss
        loss = float((reached - goal) @ z) / 2
        if step == steps or np.abs(reached - goal).max() <= within * max(goal.sum(), 1.0) or loss > before * (1 - stall):
            break
        rate = F.greatest(F.lit(float(floor)), rate - sum((p[i] * float(z[i]) for i in range(1, k)), p[0] * float(z[0])))
        if (step + 1) % FOLD == 0:
            base, rate = written(base.withColumn("rate", rate), "rates"), F.col("rate")
    return base.withColumn("rate", rate), reached


def tempered(totals: np.ndarray, power: float) -> np.ndarray:
    """Target weights: shares to a power, which flattens them."""
    shares = (totals / max(totals.sum(), 1.0)) ** power
    return shares / max(shares.sum(), 1e-12)


def expected_totals(members: DataFrame, k: int) -> np.ndarray:
    row = members.agg(*[F.sum(F.col("n") * F.col("p")[i]).alias(f"s{i}") for i in range(k)]).first()
    return np.array([row[f"s{i}"] or 0.0 for i in range(k)])


def copies(rate: Column, doc_id: Column) -> Column:
    """How often a document enters: the rate, rounded up or down by a hash of its id."""
    draw = F.pmod(F.xxhash64(doc_id, F.lit("mix")), F.lit(1 << 32)) / float(1 << 32)
    return F.floor(rate + draw).cast("long")


def op3_mixing(spark: SparkSession, docs: DataFrame, labels: DataFrame, power: float = 0.7, max_rows: int = 20_000) -> DataFrame:
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    members, names = soft_members(docs, labelled_domains(docs, labels, max_rows))
    totals = expected_totals(members, len(names))
    goal = tempered(totals, power) * totals.sum()
    rates, reached = fit_rates(members, list(goal))
    error = (reached - goal) / max(goal.sum(), 1.0)
    best = F.array_max("p")
    at = F.array_position("p", best).cast("int")
    return rates.select(
        "doc_id",
        F.element_at(F.array(*map(F.lit, names)), at).alias("domain"),
        F.round(best, 6).alias("posterior"),
        F.col("n").alias("n_tokens"),
        F.round("rate", 6).alias("rate"),
        copies(F.col("rate"), F.col("doc_id")).alias("copies"),
        F.element_at(F.array(*[F.lit(round(float(e), 6)) for e in error]), at).alias("domain_error"),
    )
