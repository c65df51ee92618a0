"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding: lower case, white space to single spaces, look-alike letters to Latin ones (compatibility forms by Unicode's own
rule, Cyrillic, Greek and Armenian ones by a table), zero-width marks dropped, digits and signs inside words to the
letters that they stand for. The lexicon (whole words, and word beginnings of four to six letters) is
learned from labelled rows: smoothed log odds of an entry's share of toxic against other documents, where it is large,
times n / (n + DOUBT) for an entry of n toxic documents. A text's evidence is the sum over matched words of their best
entry, words inside exception phrases excepted, divided by the square root of its length in words; a one-variable
logistic fit makes it a score from 0 to 1.

Sizes: the fit takes at most ``max_rows`` labelled documents, those of smallest hash, each once; they are written once,
and bound the lexicon, which is shipped to tasks. Scoring reads every row and whole texts.

Cases: a null text is empty and gets the score of no evidence; a document with several labels is toxic if one says so; a
labelled doc_id with several rows teaches one of its texts (that of smallest hash); null labels are left out; with no
labelled rows every score is 0; repeated rows are scored each; ties in the lexicon go by text; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlark.llm.common import bounded_batches, written

#: Letters that look like Latin ones (Cyrillic, Greek, Armenian, others).
LOOKALIKES = dict(
    zip(
        "авеёзікмнорстухјѕԁԛѡһґӏѵ" + "αβγεικνορτυχωϲϳ" + "աոսօհցյ" + "ıłøđħßæœþðſ",
        "abeezikmhopctyxjsdqwhrlv" + "abyeiknoptuxwcj" + "wnuohgj" + "ilodhbaopds",
        strict=True,
    )
)
#: Digits and signs that stand for letters.
DIGITS = dict(zip("013457@$", "oieastas", strict=True))
#: Phrases in which a listed word is harmless (English, German, French, Spanish).
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "clown fish", "class clown", "circus clown", "idiot proof", "stupid question", "stupid mistake", "disgusting smell", "pathetic fallacy", "sore loser",
    "clown im zirkus", "idiotensicher", "dumme frage", "dummer fehler", "ekliger geruch", "schlechter verlierer",
    "poisson clown", "clown de cirque", "question stupide", "erreur stupide", "odeur dégoûtante", "mauvais perdant",
    "pez payaso", "payaso de circo", "pregunta estúpida", "error estúpido", "cubo de basura", "mal perdedor",
)
DOUBT = 5
SIGNS = re.compile(r"[013457@$]+")
WORD = re.compile(r"[^\W_]+")


def plain_letters() -> dict[int, str | None]:
    """What translate() needs: compatibility letters as plain ones, look-alikes, and zero-width marks dropped.

    Letters with marks stay: they are letters of their languages."""
    out: dict[int, str | None] = {}
    for c in (*range(0xAA, 0x250), *range(0x1D00, 0x1F00), *range(0x2070, 0x2190), *range(0x2460, 0x2500), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)):
        plain = unicodedata.normalize("NFKC", chr(c))
        if len(plain) == 1 and plain.isascii():
            out[c] = plain.lower()
    marks = dict.fromkeys((0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD))
    return out | {ord(k): v for k, v in LOOKALIKES.items()} | marks


TABLE = plain_letters()


def fold(text: str) -> str:
    text = " ".join(text.lower().split())
    if not text.isascii():
        text = text.translate(TABLE)

    def letters(m: re.Match) -> str:
        run, before, after = m[0], text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        return "".join(map(DIGITS.get, run)) if len(run) <= 2 and (before.isalpha() or after.isalpha()) else run

    return SIGNS.sub(letters, text)


def entries_of(word: str) -> list[str]:
    """The lexicon entries that a word may match: itself, and its beginnings (marked by a star)."""
    return [word, *(word[:n] + "*" for n in (4, 5, 6) if len(word) > n)]


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 1.0
    offset: float = -1.0
    machine: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "machine": None}

    def automaton(self):
        if self.machine is None:
            import ahocorasick

            self.machine = ahocorasick.Automaton()
            known: dict[str, list] = {}
            for entry, w in self.weights.items():
                known.setdefault(entry.rstrip("*"), []).append((w, entry.endswith("*")))
            for phrase in map(fold, self.exceptions):
                known.setdefault(phrase, []).append((None, False))
            for key, uses in known.items():
                self.machine.add_word(key, (len(key), uses))
            if known:
                self.machine.make_automaton()
        return self.machine

    def evidence(self, text: str) -> float:
        """Summed weights of matched words by the square root of the number of words."""
        text = fold(text)
        machine, hits, spared = self.automaton(), {}, []
        for end, (n, uses) in machine.iter(text) if len(machine) else ():
            start = end - n + 1
            if start and text[start - 1].isalnum():
                continue
            open_end = text[end + 1 : end + 2].isalnum()
            for w, begins in uses:
                if w is None:
                    spared += [(start, end)] * (not open_end)
                elif begins == open_end:
                    hits[start] = max(hits.get(start, 0.0), w)
        total = math.fsum(w for at, w in sorted(hits.items()) if not any(a <= at <= b for a, b in spared))
        return total / math.sqrt(20 + text.count(" ")) if total else 0.0

    def score(self, text: str) -> float:
        z = self.slope * self.evidence(text) + self.offset
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, toxic) of at most max_rows labelled documents outside the held-out fold, written once."""
    bounded_batches(docs.sparkSession)
    ids = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    once = found.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("toxic").alias("toxic"))
    return written(once.select("text", "toxic"), "labelled")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(sample: DataFrame, least: int = 2, least_odds: float = 3.0) -> Lexicon:
    """sample: (text, toxic), bounded by its caller; counting and evidence run in tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                of[bool(toxic)].update({e for w in set(WORD.findall(fold(text))) if len(w) > 2 for e in entries_of(w)} | {""})
            keys = [*(of[0].keys() | of[1].keys())]
            yield pa.RecordBatch.from_pydict({"entry": keys, "clean": pa.array([of[0][k] for k in keys], pa.int64()), "toxic": pa.array([of[1][k] for k in keys], pa.int64())})

    sums = sample.mapInArrow(count, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = sums.filter("entry = ''").first()
    if total is None or not total.toxic or not total.clean:
        return Lexicon({}, slope=0.0, offset=-50.0)
    odds = F.log((F.col("toxic") + 0.5) / F.lit(total.toxic + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(total.clean + 1.0))
    kept = sums.filter(F.col("entry") != "").withColumn("odds", odds).filter((F.col("toxic") >= least) & (F.col("odds") >= least_odds))
    rows = kept.orderBy("entry").collect()  # bounded by the words of the sample's toxic documents
    lexicon = Lexicon({r.entry: r.odds * r.toxic / (r.toxic + DOUBT) for r in rows})
    return calibrated(lexicon, sample)


def calibrated(lexicon: Lexicon, sample: DataFrame) -> Lexicon:
    """Newton's method for the slope and offset, on the evidence of the bounded sample."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"x": pa.array([lexicon.evidence(t) for t in batch.column("text").to_pylist()], pa.float64()), "y": batch.column("toxic").cast(pa.int64())})

    found = sample.mapInArrow(weigh, "x double, y long").toPandas().sort_values(["x", "y"])
    x, y = np.column_stack([found.x.to_numpy(), np.ones(len(found))]), (found.y.to_numpy() != 0).astype(float)
    beta = np.array([1.0, -1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        grad = x.T @ (y - p) - 1e-3 * beta
        beta = beta + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), grad)
    return Lexicon(lexicon.weights, lexicon.exceptions, float(beta[0]), float(beta[1]))


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score) of every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array([lexicon.score(t or "") for t in batch.column("text").to_pylist()], pa.float64())})

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")


def kept_rows(docs: DataFrame, lexicon: Lexicon, below: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text scores below a bound."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([lexicon.score(t or "") < below for t in batch.column("text").to_pylist()], pa.bool_()))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(keep, docs.schema)


def op8_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    out = scored(docs, fit(labelled(docs, labels, max_rows)))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
