"""Search in texts by words, phrases and fragments, from positional postings that are built once and kept. R12, R13.

The index is three Parquet tables below one path, each in folders by a hash of the scope (a package): ``words`` (block, term,
places), ``grams`` (block, gram, places: three characters of the lower-cased text at each place) and ``builds`` (scope, digest,
n). A block is some BLOCK characters of a folder's texts, one after the other; a place counts from the block's begin and is
kept as its distance from the one before, in as few bytes as that needs. A row of an empty term lists a block's texts and where
each begins. Files are sorted by term or gram, so a search reads the row groups of its terms and no text; a block's postings
are made by the task that has its texts, so a build moves each text once and no posting.

A build (R12) digests every scope and writes only the folders that hold a scope whose digest has changed, by dynamic
partition overwrite: a second build of the same texts writes nothing. ``builds`` is written last, so a build that broke off
is done again.

Cases: a null text or id is left out; a null scope is a scope of its own; rows equal in scope and id are one text (the
largest); texts are of any length; an empty table builds an empty index. A query without a word and with a blank fragment
finds nothing; so does an alternative that only excludes.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planlark.operators.retrieval import words_of
from planlark.sources.work import written

#: Follows every text, so that the last characters begin a gram too.
END = "\0\0"
#: Characters of a block; a longer text is a block of its own.
BLOCK = 1 << 20
#: Of a search query: a phrase or a word, with a minus sign or without.
CLAUSE = re.compile(r'(-?)(?:"([^"]*)"?|(\S+))')
POSTINGS = "block long, {} string, places binary, ids array<long>, scopes array<string>"
SCHEMAS = {"words": POSTINGS.format("term"), "grams": POSTINGS.format("gram"), "builds": "scope string, digest string, n long"}


def packed(places: np.ndarray, firsts: np.ndarray) -> pa.Array:
    """The rising places of each run (that begins at ``firsts``) as bytes: seven bits of a distance each, the last below 128."""
    gaps = np.diff(places, prepend=0)
    gaps[firsts] = places[firsts]
    sizes = 1 + sum((gaps >= 1 << bits).astype(np.int64) for bits in (7, 14, 21, 28))
    at = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), dtype=np.uint8)
    for j in range(5):
        has = sizes > j
        out[at[has] + j] = (gaps[has] >> 7 * j & 127) | (sizes[has] > j + 1) << 7
    ends = np.append(at[firsts], len(out)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(firsts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(out.tobytes())])


def unpacked(data: bytes) -> np.ndarray:
    v = np.frombuffer(data, dtype=np.uint8)
    last = np.flatnonzero(v < 128)
    first = np.append(0, last[:-1] + 1)
    nth = np.arange(len(v)) - np.repeat(first, last - first + 1)
    return np.cumsum(np.add.reduceat((v & 127).astype(np.int64) << 7 * nth, first))


def word_postings(texts: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The terms of a block, their places one term after the other, where each term's begin, and where each text begins."""
    code: dict[str, int] = {}
    codes = np.array([code.setdefault(w, len(code)) for ws in texts for w in ws], dtype=np.int32)
    places = np.argsort(codes, kind="stable")
    return list(code), places, np.flatnonzero(np.diff(codes[places], prepend=-1)), np.cumsum([0, *map(len, texts)])[:-1]


def gram_postings(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """As ``word_postings``, of three characters at each place of a text."""
    chars = np.frombuffer("".join(t + END for t in texts).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    ends = np.cumsum([len(t) + len(END) for t in texts])
    begins = np.ones(max(len(chars) - 2, 0), dtype=bool)
    for n in (1, 2):
        begins[(ends - n)[ends - n < len(begins)]] = False
    at = np.flatnonzero(begins)
    keys = chars[at] << 42 | chars[at + 1] << 21 | chars[at + 2]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    firsts = np.flatnonzero(np.diff(keys, prepend=-1))
    each = keys[firsts]
    joined = np.stack([each >> 42, each >> 21 & (1 << 21) - 1, each & (1 << 21) - 1], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    return [joined[i : i + 3] for i in range(0, len(joined), 3)], at[order], firsts, np.append(0, ends[:-1])


def postings(rows: DataFrame, value: Column, key: str, made: Callable) -> DataFrame:
    """(part, block, key, places, ids, scopes) of rows (part, scope, id, text), which are sorted by part in their partitions."""

    def block(number: int, part: int, scopes: list, ids: list, texts: list) -> pa.RecordBatch:
        keys, places, firsts, starts = made(texts)
        listed = pa.concat_arrays([packed(starts, np.array([0])), packed(places, firsts)])
        n, none = len(keys) + 1, [None] * len(keys)
        columns = {"part": pa.array([part] * n, pa.int32()), "block": pa.array([number] * n, pa.int64()), key: pa.array(["", *keys], pa.string()), "places": listed}
        return pa.RecordBatch.from_pydict(columns | {"ids": pa.array([ids, *none], pa.list_(pa.int64())), "scopes": pa.array([scopes, *none], pa.list_(pa.string()))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, of, held = TaskContext.get().partitionId() << 32, 0, None, ([], [], [])
        for batch in batches:
            for part, chars, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "chars", "scope", "id", "value")), strict=True):
                if held[0] and (part != of or size + chars > BLOCK):
                    yield block(number, of, *held)
                    number, size, held = number + 1, 0, ([], [], [])
                of, size = part, size + chars
                for column, x in zip(held, row, strict=True):
                    column.append(x)
        if held[0]:
            yield block(number, of, *held)

    return rows.select("part", F.length("text").alias("chars"), "scope", "id", value.alias("value")).mapInArrow(run, f"part int, {SCHEMAS[key + 's' if key == 'gram' else 'words']}")


class TextIndex:
    """An index below ``path``, in ``parts`` folders."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 16):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts
        for name, schema in SCHEMAS.items():
            self._written(spark.createDataFrame([], f"{schema}, part int"), name, "ignore")

    def _written(self, rows: DataFrame, name: str, mode: str) -> None:
        rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.path}/{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{SCHEMAS[name]}, part int").parquet(f"{self.path}/{name}")

    def part_of(self, scope: Column) -> Column:
        return F.pmod(F.xxhash64(scope), F.lit(self.parts)).cast("int")

    def build(self, texts: DataFrame) -> list[int]:
        """Index texts (scope, id, text), which are all there are; returns the folders that were written. R12."""
        scope = F.col("scope").cast("string")
        whole = texts.filter("id IS NOT NULL AND text IS NOT NULL").groupBy(scope.alias("scope"), F.col("id").cast("long").alias("id")).agg(F.max("text").alias("text"))
        # texts move once: both tables and the digests are made from what is written here
        rows = written(whole.withColumn("part", self.part_of(F.col("scope"))).sortWithinPartitions("part"), "texts")
        # a digest of a scope from partial sums, whatever the order: three sums of 60 bits of each text's digest
        sha = F.sha2(F.concat_ws("\0", F.col("id").cast("string"), "text").cast("binary"), 256)
        sums = [F.sum(F.conv(F.substring(sha, at, 15), 16, 10).cast("decimal(38,0)")).cast("string") for at in (1, 16, 31)]
        new = written(rows.groupBy("scope", "part").agg(F.concat_ws("-", *sums).alias("digest"), F.count("*").alias("n")), "digests")
        old = self.table("builds").filter("digest IS NOT NULL")
        same = F.col("new.scope").eqNullSafe(F.col("old.scope")) & (F.col("new.digest") == F.col("old.digest"))
        differs = new.alias("new").join(old.alias("old"), same, "left_anti").select("part").union(old.alias("old").join(new.alias("new"), same, "left_anti").select("part"))
        changed = sorted(r.part for r in differs.distinct().collect())  # as many as there are folders at most
        if not changed:
            return []
        here = F.col("part").isin(changed)
        kinds = [("words", "term", words_of(F.col("text")), word_postings), ("grams", "gram", F.lower("text"), gram_postings)]
        for name, key, value, made in kinds:
            self._overwrite(postings(rows.filter(here), value, key, made).sortWithinPartitions("part", key), name, changed)
        self._overwrite(new.filter(here), "builds", changed)
        return changed

    def _overwrite(self, rows: DataFrame, name: str, changed: list[int]) -> None:
        """Write the folders anew. A row of nulls in each has it replaced even where no text is left; no join meets it."""
        nulls = self.spark.createDataFrame([(part,) for part in changed], "part int")
        self._written(rows.unionByName(nulls, allowMissingColumns=True), name, "overwrite")

    # ---- search

    def search(self, queries: DataFrame) -> DataFrame:
        """(query_id, scope, id, rank) of texts that match; queries are (query_id, text) over all scopes, or also have a scope.

        A text matches when its words match the query (words, "phrases", -excluded, or between alternatives), or when the
        whole query stands anywhere in it, whatever the case. The rank is the cover density of the words: 0.1 for each
        least cover of an alternative's words, divided by one more than the other words inside; 0 where only the fragment
        is found. Order by rank, largest first. The postings of asked terms meet by block, once whatever asks for them, and a block
        answers all queries."""
        asked = queries.select("query_id", "text", F.col("scope").cast("string").alias("scope")) if "scope" in queries.columns else queries.select("query_id", "text", F.lit(None).cast("string").alias("scope"))
        asked = asked.filter("text IS NOT NULL")
        words, grams = self._by_words(clauses(asked)), self._by_fragment(asked)
        both = words.unionByName(grams.withColumn("rank", F.lit(0.0)))
        return both.groupBy("query_id", "scope", "id").agg(F.max("rank").alias("rank"))

    def _in_blocks(self, name: str, key: str, asked: list[tuple[DataFrame, Column]], match: Callable, kind: str) -> DataFrame:
        """(query_id, scope, id, rank) by ``match`` in each block. asked: what is asked (a column key, and further ones) and the
        part of a posting's key that it meets."""
        table, met = self.table(name), []
        for rows, of in asked:
            askers = written(rows.groupBy(F.col(key).alias("__key")).agg(F.collect_list(F.struct(*[c for c in rows.columns if c != key])).alias("askers")), "askers")
            met.append(table.join(askers, of == F.col("__key")).select("part", "block", key, "places", "ids", "scopes", "askers"))
        texts = table.filter(F.col(key) == "").select("part", "block", key, "places", "ids", "scopes")
        rows = met[0]
        for more in met[1:]:
            rows = rows.unionByName(more)

        def run(group: pa.Table) -> pa.Table:
            found: dict[str, list] = {c: [] for c in ("query_id", "scope", "id", "rank")}
            rows = group.to_pylist()
            texts = next((r for r in rows if r[key] == ""), None)
            if texts is not None and len(rows) > 1:
                starts = unpacked(texts["places"])
                for query, text, rank in match(Places(rows, key), starts, texts["scopes"]):
                    for c, x in zip(found, (query, texts["scopes"][text], texts["ids"][text], rank), strict=True):
                        found[c].append(x)
            id_type = group.schema.field("askers").type.value_type.field("query_id").type
            types = dict(zip(found, (id_type, pa.string(), pa.int64(), pa.float64()), strict=True))
            return pa.table({c: pa.array(found[c], t) for c, t in types.items()})

        return rows.unionByName(texts, allowMissingColumns=True).groupBy("part", "block").applyInArrow(run, f"query_id {kind}, scope string, id long, rank double")

    def _by_words(self, asked: DataFrame) -> DataFrame:
        """asked: (query_id, scope, alt, clause, without, k, term, size, clauses), a row a word."""

        def match(places: Places, starts: np.ndarray, scopes: list) -> Iterator[tuple]:
            alts: dict[tuple, dict] = {}
            for term, a in places.askers():
                alts.setdefault((a["query_id"], a["alt"]), {}).setdefault(a["clause"], (a, {}))[1][a["k"]] = term
            for (query, _), clauses_ in alts.items():
                one = next(a for a, _ in clauses_.values())
                wanted = [(a, ks) for a, ks in clauses_.values() if not a["without"] and len(ks) == a["size"]]
                if len(wanted) < one["clauses"]:
                    continue
                hits, texts = [], None
                for a, ks in sorted(wanted, key=lambda c: min(len(places[t]) for t in c[1].values())):
                    at = places.runs(ks, starts)
                    here = np.unique(text_of(starts, at))
                    texts = here if texts is None else np.intersect1d(texts, here, assume_unique=True)
                    hits.append((a["size"], at, ks))
                    if not len(texts):
                        break
                for a, ks in clauses_.values():
                    if len(texts) and a["without"] and len(ks) == a["size"]:
                        texts = np.setdiff1d(texts, text_of(starts, places.runs(ks, starts)), assume_unique=False)
                for text in texts.tolist():
                    if one["scope"] is None or one["scope"] == scopes[text]:
                        low, high = starts[text], starts[text + 1] if text + 1 < len(starts) else None
                        part = lambda v: v[np.searchsorted(v, low) : None if high is None else np.searchsorted(v, high)].tolist()  # noqa: E731, B023
                        yield query, text, rank([{"size": n, "starts": part(at), "every": {p for t in set(ks.values()) for p in part(places[t])}} for n, at, ks in hits])

        return self._in_blocks("words", "term", [(asked, F.col("term"))], match, dict(asked.dtypes)["query_id"])

    def _by_fragment(self, asked: DataFrame) -> DataFrame:
        """Texts that hold the whole query: its grams stand at places that fit together. A query of one or two characters is
        the beginning of grams, of which each place of a text has one."""
        f = asked.select("query_id", "scope", F.lower(F.btrim("text")).alias("f")).filter("f <> ''").withColumn("m", F.char_length("f"))
        # every third gram and the last one leave no character out
        ks = F.array_distinct(F.concat(F.sequence(F.lit(0), F.col("m") - 3, F.lit(3)), F.array(F.col("m") - 3)))
        long = f.filter("m >= 3").withColumn("n", F.size(ks)).select("query_id", "scope", "m", "n", "f", F.explode(ks).alias("k"))
        long = long.select("query_id", "scope", "m", "n", "k", F.substring("f", F.col("k") + 1, 3).alias("gram"))
        short = [(f.filter(F.col("m") == n).select("query_id", "scope", "m", F.lit(0).alias("n"), F.lit(0).alias("k"), F.col("f").alias("gram")), F.substring("gram", 1, n)) for n in (1, 2)]

        def match(places: Places, starts: np.ndarray, scopes: list) -> Iterator[tuple]:
            wanted: dict[tuple, list] = {}
            for gram, a in places.askers():
                wanted.setdefault((a["query_id"], a["scope"], a["m"], a["n"]), []).append((a["k"], gram))
            for (query, scope, m, n), grams in wanted.items():
                if n and len(grams) < n:
                    continue
                at = places.runs(dict(grams), starts, m - 2) if n else np.concatenate([places[g] for _, g in grams])
                for text in np.unique(text_of(starts, at)).tolist():
                    if scope is None or scope == scopes[text]:
                        yield query, text, 0.0

        return self._in_blocks("grams", "gram", [(long, F.col("gram")), *short], match, dict(asked.dtypes)["query_id"])


def text_of(starts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The text in which each place lies; texts without a word begin where the next one does."""
    return np.searchsorted(starts, places, side="right") - 1


class Places:
    """A block's places by key, each unpacked when it is first asked for."""

    def __init__(self, rows: list[dict], key: str):
        self.rows, self.key = [r for r in rows if r[key] != ""], key
        self.data = {r[key]: r["places"] for r in self.rows}
        self.read: dict[str, np.ndarray] = {}

    def askers(self) -> Iterator[tuple[str, dict]]:
        return ((r[self.key], a) for r in self.rows for a in r["askers"])

    def __getitem__(self, key: str) -> np.ndarray:
        if key not in self.read:
            self.read[key] = unpacked(self.data[key])
        return self.read[key]

    def runs(self, keys: dict[int, str], starts: np.ndarray, size: int = 0) -> np.ndarray:
        """Where keys stand in order (each at its k), in one text from the first to the last."""
        least = sorted(keys, key=lambda k: len(self.data[keys[k]]))
        at = self[keys[least[0]]] - least[0]
        for k in least[1:]:
            other = self[keys[k]]
            i = np.searchsorted(other, at + k)
            at = at[(i < len(other)) & (other[np.minimum(i, len(other) - 1)] == at + k)]
        last = at + (size or len(keys)) - 1
        return at[(at >= 0) & (text_of(starts, at) == text_of(starts, last))]


def clauses(queries: DataFrame) -> DataFrame:
    """(query_id, scope, alt, clause, without, k, term, size, clauses): each word of each query's clauses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("at", "alt", "clause", "without", "text")}
            for at, text in enumerate(batch.column("text").to_pylist()):
                alt = 0
                for number, m in enumerate(CLAUSE.finditer(text)):
                    if m[3] and m[3].lower() == "or" and not m[1]:
                        alt += 1
                        continue
                    for c, v in (("at", at), ("alt", alt), ("clause", number), ("without", m[1] == "-"), ("text", m[2] if m[2] is not None else m[3])):
                        out[c].append(v)
            at = pa.array(out["at"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id").take(at), batch.column("scope").take(at), pa.array(out["alt"], pa.int32()), pa.array(out["clause"], pa.int32()), pa.array(out["without"], pa.bool_()), pa.array(out["text"], pa.string())],
                names=["query_id", "scope", "alt", "clause", "without", "text"],
            )

    kind = dict(queries.dtypes)["query_id"]
    found = queries.select("query_id", "scope", "text").mapInArrow(run, f"query_id {kind}, scope string, alt int, clause int, without boolean, text string")
    words = found.withColumn("words", words_of(F.col("text"))).filter(F.size("words") > 0).withColumn("size", F.size("words"))
    counts = words.groupBy("query_id", "alt").agg(F.count_if(~F.col("without")).alias("clauses"))
    each = words.select("query_id", "scope", "alt", "clause", "without", "size", F.posexplode("words").alias("k", "term"))
    return each.join(counts, ["query_id", "alt"]).filter("clauses > 0")


def rank(parts: list[dict]) -> float:
    """The cover density of clauses: for each its size, its starts and all places of its words."""
    ends = sorted((s + p["size"] - 1, s, i) for i, p in enumerate(parts) for s in p["starts"])
    every = sorted({w for p in parts for w in p["every"]})
    last, begun, total = [-1] * len(parts), -1, 0.0
    for n, (end, start, i) in enumerate(ends):
        last[i] = max(last[i], start)
        if n + 1 < len(ends) and ends[n + 1][0] == end:
            continue
        first = min(last)
        if first > begun:
            begun = first
            inside = bisect_right(every, end) - bisect_left(every, first)
            total += 0.1 / (1 + end - first + 1 - inside)
    return total
