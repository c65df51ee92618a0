"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Base spans are the leftmost non-overlapping matches of three patterns. The method adds spans of kind ``markov``: runs of
at least MIN_RUN key characters outside of base spans (what a base span leaves of a longer run is a run of its own) that
a first-order character model of random strings explains better than one of ordinary identifiers, by at least MIN_RATIO
nats in all and MIN_MEAN a character. Both models are trained here from labelled samples. Random strings are drawn by
hashing numbers (in base64), so they are labelled by how they are made; values of assignments in the documents join
them, which is self-labelling. Ordinary identifiers are words of the documents.

Everything is built-in functions: ``split`` gives the text between matches and ``regexp_extract_all`` the matches, so
running sums of lengths give positions in code points. The sums are taken in blocks of SUM_BLOCK, and tokens are read as
arrays of characters, so the work grows with the text.

Sizes: training takes at most ``max_rows`` documents of each label (those of smallest hash) and DRAWN drawn strings; the
model is CELLS numbers. The scan reads every row and whole texts, with no shuffle.

Cases: a null text is empty and has no spans; with no words to learn from the method adds no span; repeated rows are
scanned each; one token may fill a very long text; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planlark.functions.rational import let

#: The base patterns, and the characters (for assign: of group 2) that a match needs to stay.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: The same matches after dropping, found faster: a kept match is a whole run, which these take or leave as a whole.
ACCESS_KEPT, HEX_KEPT = r"AKIA[A-Z0-9]{16,}", r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "markov"]

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIDE = len(ALPHABET) + 1
CELLS = SIDE * SIDE
MIN_RUN, MIN_RATIO, MIN_MEAN = 14, 8.0, 0.5
RUN = rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}"
WORD = r"[A-Za-z_-]{6,}"
DRAWN, SUM_BLOCK = 4096, 256


def starts_of(steps: Column) -> Column:
    """array<struct<start, n>> for steps (gap, n): running sums in blocks, each begun by a running sum over the blocks."""
    size = lambda s: s["gap"] + s["n"]
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / SUM_BLOCK).cast("int")), lambda b: F.slice(steps, b * SUM_BLOCK + 1, SUM_BLOCK))

    def running(items: Column, first: Column, length, row) -> Column:
        """Running sum before each item; ``row`` makes the entry from it."""
        return F.aggregate(items, F.struct(first.alias("at"), F.slice(F.transform(items, lambda s: row(F.lit(0), s)), 1, 0).alias("out")), lambda acc, s: F.struct((acc["at"] + length(s)).alias("at"), F.concat(acc["out"], F.array(row(acc["at"], s))).alias("out")), lambda acc: acc["out"])

    sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda t, s: t + size(s)))
    begins = running(sums, F.lit(0), lambda n: n, lambda at, _: at)
    row = lambda at, s: F.struct((at + s["gap"]).alias("start"), s["n"].alias("n"))
    return F.flatten(F.zip_with(blocks, begins, lambda block, first: running(block, first, size, row)))


def spans(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """array<struct<start, kind, end, value>> of the pattern's matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    before = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    steps = F.zip_with(F.slice(before, 1, F.size(found)), F.transform(found, lambda x: F.length(x)), lambda gap, n: F.struct(gap.alias("gap"), n.alias("n")))
    placed = starts_of(steps)
    order = KINDS.index(kind)
    all_spans = F.zip_with(placed, values, lambda p, v: F.struct(p["start"].alias("start"), F.lit(order).alias("kind"), (p["start"] + p["n"]).alias("end"), v.alias("value")))
    return F.when(text.rlike(pattern), all_spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds ``base``: the base spans by start, then kind."""
    t = F.col("text")
    assign = F.filter(spans(t, ASSIGN, "assign", 2), lambda s: F.length(s["value"]) >= LEAST["assign"])
    return docs.withColumn("base", F.array_sort(F.concat(assign, spans(t, ACCESS_KEPT, "access"), spans(t, HEX_KEPT, "hex"))))


def cells(token: Column) -> Column:
    """The model's cell of each pair of neighbouring characters."""
    codes = F.transform(F.split(token, "", -1), lambda c: F.when(c == "", 0).otherwise(F.call_function("locate", c, F.lit(ALPHABET))))
    n = F.length(token)
    return F.zip_with(F.slice(codes, 1, n - 1), F.slice(codes, 2, n - 1), lambda a, b: a * SIDE + b)


def drawn_strings(spark: SparkSession) -> DataFrame:
    """(random, token): strings that are random by the way they are made."""
    coded = F.rtrim(F.base64(F.unhex(F.sha2(F.concat(F.lit("drawn"), F.col("id").cast("string")), 256))), F.lit("="))
    return spark.range(DRAWN).select(F.lit(True).alias("random"), coded.alias("token"))


def labelled_samples(docs: DataFrame, max_rows: int) -> DataFrame:
    """(random, token) from at most max_rows documents of each label."""

    def picked(rows: DataFrame) -> DataFrame:
        ids = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # ids alone, so no text meets in one task
        return docs.join(F.broadcast(ids), "doc_id", "left_semi")

    has = docs.filter(F.col("text").rlike(ASSIGN))
    secret = base_spans(picked(has))
    assigned = F.filter("base", lambda s: s["kind"] == KINDS.index("assign"))
    random = secret.select(F.lit(True).alias("random"), F.explode(assigned["value"]).alias("token")).filter(F.length("token") >= 12)
    plain = picked(docs).select(F.lit(False).alias("random"), F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("token"))
    return random.unionByName(plain).unionByName(drawn_strings(docs.sparkSession))


def fit(samples: DataFrame) -> list[float] | None:
    """Log-likelihood ratio of each pair of characters, from add-one counts; at most 2 * CELLS rows come to the driver."""
    pairs = samples.filter(F.length("token") > 1).select("random", F.explode(cells(F.col("token"))).alias("cell"))
    counts = {(r.random, r.cell): r["count"] for r in pairs.groupBy("random", "cell").count().collect()}
    if {k for k, _ in counts} != {True, False}:
        return None
    sums = {}
    for (label, cell), n in counts.items():
        sums[label, cell // SIDE] = sums.get((label, cell // SIDE), 0) + n
    share = lambda label, cell: math.log((counts.get((label, cell), 0) + 1) / (sums.get((label, cell // SIDE), 0) + SIDE))
    return [share(True, c) - share(False, c) for c in range(CELLS)]


def scan(docs: DataFrame, ratios: list[float] | None) -> DataFrame:
    """docs: (doc_id, text). Adds ``base`` and ``all``, arrays of spans."""
    found = base_spans(docs)
    if ratios is None:
        return found.withColumn("all", F.col("base"))
    model = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")  # folded to a constant
    ratio = lambda token: F.aggregate(cells(token), F.lit(0.0), lambda acc, c: acc + F.element_at(model, c + 1))
    odd = lambda s: let(ratio(s["value"]), lambda r: (r >= MIN_RATIO) & (r >= MIN_MEAN * F.length(s["value"])))
    added = F.filter(spans(F.col("free"), RUN, "markov"), odd)
    return found.withColumn("free", outside("base")).withColumn("all", F.array_sort(F.concat("base", added))).drop("free")


def blanked(text: Column, pattern: str, least: int = 0) -> Column:
    """The text with kept matches of the pattern as so many spaces."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least else found
    blanks = F.zip_with(found, kept, lambda m, v: F.when(F.length(v) >= least, F.repeat(F.lit(" "), F.length(m))).otherwise(m))
    return F.array_join(F.flatten(F.zip_with(F.split(text, pattern, -1), blanks, lambda gap, m: F.array(gap, F.coalesce(m, F.lit(""))))), "")


def outside(base: str) -> Column:
    """The text with base spans as spaces, so that positions stay."""
    t = F.col("text")
    chars = [F.split(blanked(t, pattern, least), "", -1) for pattern, least in ((ASSIGN, LEAST["assign"]), (ACCESS_KEPT, 0), (HEX_KEPT, 0))]
    blank = lambda a, b: F.when(b == " ", b).otherwise(a)
    return F.when(F.size(base) == 0, t).otherwise(F.array_join(F.zip_with(F.zip_with(chars[0], chars[1], blank), chars[2], blank), ""))


def joined(spans_column: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_column, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secrets(spark: SparkSession, docs: DataFrame, max_rows: int = 2000) -> DataFrame:
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = scan(docs, fit(labelled_samples(docs, max_rows))).select("doc_id", "base", "all")
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("all").alias("spans"))
