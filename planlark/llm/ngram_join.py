"""N-gram Jaccard join by prefix filtering and tries, and the groups that its links form.

A document's set holds its distinct five-word shingles, as 64-bit hashes. Two sets of Jaccard similarity 3/4 or more
share one of the first n / 4 + 1 elements of each, in any order that all sets follow. Here common shingles come last,
and hashes decide the rest.

1. Each text gives its set's size and hash; equal sets are one class from here on (copies cost nothing further). The
   hash has 128 bits, of which 64 name the class; where two sets share a name, one takes its other half.
   The same pass counts shingles that recur within a task; the most frequent ones (HEAVY_MAX at most) form the tail of
   the order. They only shape the order and the dealing, so any such list gives the same links.
2. Each class posts its prefix; postings meet by shingle. Pairs pass the length and position bounds to be candidates.
   A shingle of up to SMALL classes gives all its pairs; one of more gives pairs with LEADERS leaders, and its postings
   go on to step 3. A sketch of each set (the parity of its elements in a number of bits that follows its size) then drops
   pairs whose sketches differ in more bits than similar sets can differ in elements; two sets never differ in fewer
   elements than their sketches in bits.
3. The pairs that are left form neighbourhoods (components of candidates). The postings of shingles with many classes
   are compared once more, by sketch, between neighbourhoods: a pair that has a chance unites two of them. So each pair
   of similar sets lies inside one neighbourhood.
4. Prefix-tree join: each class's text goes to its neighbourhood, once, and the ordered sets there form one trie. A walk
   over the trie carries the overlaps with all sets of the neighbourhood at once, counts a shared path once, and leaves a
   subtree when the elements that remain cannot reach the bound for any of them. It gives each class's number of links,
   and links enough to connect what is connected; these give the components. In a neighbourhood too large for one task
   each set is written as its difference from the first one, L: with D the elements of A or L that the other lacks, and
   m those of L that A lacks, the overlap of A and B is |L| - m(A) - m(B) + |D(A) and D(B)|. So the differences, which
   are short among near copies, form the tries, in tiles of two blocks.

Skew: copies are pre-aggregated. The postings of one shingle are dealt in blocks of about CROWD, whose leaders meet in a
second round; step 3 deals its classes in blocks of TILE, a task holding two of them, and emits at most a pair for each
union. The differences of a large neighbourhood are dealt in blocks of TILE classes too, each going once to each tile of
its block. What stays quadratic is the work of counting links inside one neighbourhood, and step 3's comparison for a shingle
shared by many classes that are unlike each other although it is among the rarest of each. Rows do not: no pairs leave
a task but those that unite.

Cases: null and empty texts, and texts without words, have an empty set, no link and their own id as component; texts of
fewer than five words have one shingle; a class is named by its smallest doc_id, so rows of one doc_id and different
texts meet where that is the smallest of both; a null doc_id has a null component, and a set that only such rows have is
no partner; repeated rows are reported each; very long texts are hashed in spans of SPAN bytes; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planlark.llm.bpe_chunks import BASE, INVERSE, mixed, powers
from planlark.llm.common import bounded_batches, join_groups, written
from planlark.llm.components import components

WIDTH = 5
HEAVY_MAX, HEAVY_LEAST = 100_000, 20
SMALL, LEADERS, CROWD, TILE = 12, 3, 4096, 1024
#: A block of a neighbourhood's classes holds so many shingles at most, on average.
TILE_SHINGLES = 1 << 20
#: Classes whose place is broadcast (some 40 bytes each) to the scan of the texts; more meet them in a sort-merge join.
FEW_IDS = 500_000
SKETCH_BITS = 1024
#: Texts are hashed in spans of so many bytes; a word of more than LONG bytes is hashed by itself.
SPAN, LONG = 1 << 16, 1 << 12
#: What a task remembers to post a class once; forgetting costs repeated postings only.
SEEN_MAX = 200_000
#: Two classes of one 64-bit name: expected once in 6e9 classes, so the list stays short.
CLASHES_MAX = 100_000
EMPTY = np.empty(0, dtype=np.uint64)


class Shingler:
    def __init__(self):
        self.up, self.down = powers(BASE, SPAN + LONG), powers(INVERSE, SPAN + LONG)
        self.factors = mixed(np.arange(1, WIDTH + 1, dtype=np.uint64) * BASE) | np.uint64(1)

    def words(self, raw: np.ndarray) -> np.ndarray:
        """A hash of each word of the text's bytes."""
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
        starts, ends = edge[::2], edge[1::2]
        out = np.empty(len(starts), dtype=np.uint64)
        bounds = np.append(np.searchsorted(starts, np.arange(0, len(raw), SPAN)), len(starts))
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if a == b:
                continue
            part = raw[k * SPAN : (k + 1) * SPAN + LONG]
            part = part + (((part >= 65) & (part <= 90)) * np.uint8(32))
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * self.up[: len(part)], out=sums[1:])
            s, size = starts[a:b] - k * SPAN, ends[a:b] - starts[a:b]
            out[a:b] = mixed((sums[np.minimum(s + size, len(part))] - sums[s]) * self.down[s] + size.astype(np.uint64))
            for i in a + np.flatnonzero(size > LONG):
                word = bytes(raw[starts[i] : ends[i]]).lower()  # of bytes: A-Z alone
                out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return out

    def __call__(self, text: str) -> np.ndarray:
        """The sorted set of shingle hashes."""
        words = self.words(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8))
        m = len(words)
        if not m:
            return EMPTY
        width = min(m, WIDTH)
        out = np.full(m - width + 1, width, dtype=np.uint64)
        for k in range(width):
            out += words[k : m - width + 1 + k] * self.factors[k]
        return np.unique(mixed(out))


def names(hashes: np.ndarray) -> tuple[int, int]:
    """The class's name, and the number that takes its place where another set has that name."""
    digest = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def class_hash(hashes: np.ndarray, clashes: dict[int, int]) -> int:
    """clashes: for a name that several sets have, the second number of the set that keeps it."""
    name, second = names(hashes)
    return second if name in clashes and clashes[name] != second else name


class Heavy(NamedTuple):
    """The most frequent shingles, sorted, and the number of blocks in which each one's postings are dealt."""

    values: np.ndarray
    blocks: np.ndarray


def ordered(hashes: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """The set in the order of all sets: by hash, common shingles last."""
    if not len(heavy) or not len(hashes):
        return hashes
    at = np.minimum(np.searchsorted(heavy, hashes), len(heavy) - 1)
    common = heavy[at] == hashes
    return np.concatenate([hashes[~common], hashes[common]])


def fits(n_a, at_a, n_b, at_b):
    """Whether sets of these sizes, whose first common element is at these places, can be similar enough."""
    least, most = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    return (4 * least >= 3 * most) & (7 * np.minimum(n_a - at_a, n_b - at_b) >= 3 * (n_a + n_b))


def similar(common: int, n_a: int, n_b: int) -> bool:
    return 100 * common >= 75 * (n_a + n_b - common)


def sketch_of(hashes: np.ndarray) -> bytes:
    """Parities of the elements in some eight bits an element, up to SKETCH_BITS, and one to two bits from there on.

    A bit an element is enough to tell: sets of similarity 0.6 or less differ in more bits on average than similar ones can.
    """
    n = len(hashes)
    bits = max(64, min(SKETCH_BITS, 1 << (8 * n - 1).bit_length()), 1 << (n - 1).bit_length())
    parity = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch at a smaller size (in bytes, a power of two)."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, dtype=np.uint64).reshape(-1, size // 8), axis=0)


def apart(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ at the smaller one's size."""
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())


def profile(docs: DataFrame) -> DataFrame:
    """(doc_id, n, cls, second, sketch) of each document, and (null, count, .., shingle) of recurring shingles.

    The sketch is given where a task first meets the class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen, held, size = Shingler(), set(), [], 0
        kept, counts = EMPTY, np.empty(0, dtype=np.int64)

        def merged(kept, counts, held):
            values, n = np.unique(np.concatenate(held), return_counts=True) if held else (EMPTY, counts[:0])
            values, n = np.concatenate([kept, values[n > 1]]), np.concatenate([counts, n[n > 1]])
            values, back = np.unique(values, return_inverse=True)
            n = np.bincount(back, weights=n, minlength=len(values)).astype(np.int64)
            if len(values) > HEAVY_MAX:
                top = np.argsort(-n, kind="stable")[:HEAVY_MAX]
                values, n = values[top], n[top]
            return values, n

        def rows(doc_id, n, cls, second, sketch, shingle):
            return pa.RecordBatch.from_pydict({"doc_id": doc_id, "n": pa.array(n, pa.int64()), "cls": pa.array(cls, pa.int64()), "second": pa.array(second, pa.int64()), "sketch": pa.array(sketch, pa.binary()), "shingle": shingle})

        for batch in batches:
            sizes, classes, seconds, sketches = [], [], [], []
            for text in batch.column("text").to_pylist():
                h = shingler(text or "")
                name, second = names(h) if len(h) else (None, None)
                fresh = len(h) and name ^ second not in seen
                sizes.append(len(h))
                classes.append(name)
                seconds.append(second)
                sketches.append(sketch_of(h) if fresh else None)
                if fresh:
                    seen.add(name ^ second)
                    held.append(h)
                    size += len(h)
                if size > 1_000_000:
                    kept, counts = merged(kept, counts, held)
                    held, size = [], 0
                if len(seen) > SEEN_MAX:
                    seen.clear()
            yield rows(batch.column("doc_id"), sizes, classes, seconds, sketches, pa.nulls(len(sizes), pa.int64()))
        kept, counts = merged(kept, counts, held)
        more = counts > 2
        none = [None] * int(more.sum())
        yield rows(pa.nulls(len(none), pa.int64()), counts[more], none, none, none, pa.array(kept[more].view(np.int64)))

    return docs.mapInArrow(run, "doc_id long, n long, cls long, second long, sketch binary, shingle long")


def heavy_shingles(profiled: DataFrame) -> Heavy:
    """At most HEAVY_MAX shingles."""
    sums = profiled.filter("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= HEAVY_LEAST)
    rows = sums.orderBy(F.desc("n"), "shingle").limit(HEAVY_MAX).toPandas()
    values, n = rows["shingle"].to_numpy(dtype=np.int64).view(np.uint64), rows["n"].to_numpy(dtype=np.int64)
    order = np.argsort(values)
    return Heavy(values[order], np.minimum(-(-n // CROWD), (1 << SALT_BITS) - 1)[order])


#: ``place`` packs the set's size, the element's place in it and the salt, which is 0 for a shingle whose postings are
#: dealt together, else the block; ``before`` is the element before this one.
POSTING = "w long, cls long, place long, before long"
N_BITS, AT_BITS, SALT_BITS = 26, 24, 14


def packed(n: np.ndarray, at: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return (n.astype(np.int64) << (AT_BITS + SALT_BITS)) | (at.astype(np.int64) << SALT_BITS) | salt


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> (AT_BITS + SALT_BITS), (place >> SALT_BITS) & ((1 << AT_BITS) - 1), place & ((1 << SALT_BITS) - 1)


def salt_of(place: str) -> Column:
    return F.col(place).bitwiseAND((1 << SALT_BITS) - 1)


def postings(docs: DataFrame, heavy: Heavy, clashes: dict[int, int]) -> DataFrame:
    """A row per class (once a task) and element of its prefix."""
    shared = docs.sparkSession.sparkContext.broadcast((heavy.values, heavy.blocks, clashes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, blocks, clashes = shared.value
        shingler, seen, cols, size = Shingler(), set(), [], 0

        def out():
            w, cls, n, at, before = (np.concatenate(c) for c in zip(*cols, strict=True))
            salt = np.zeros(len(w), dtype=np.int64)
            if (blocks > 1).any():
                k = np.minimum(np.searchsorted(values, w), len(values) - 1)
                i = np.flatnonzero((values[k] == w) & (blocks[k] > 1))
                salt[i] = 1 + (mixed(cls[i].view(np.uint64) ^ w[i]) % blocks[k[i]].astype(np.uint64)).astype(np.int64)
            return pa.RecordBatch.from_pydict({"w": w.view(np.int64), "cls": cls, "place": packed(n, at, salt), "before": before.view(np.int64)})

        for batch in batches:
            for text in batch.column("text").to_pylist():
                h = shingler(text or "")
                if not len(h) or (c := class_hash(h, clashes)) in seen:
                    continue
                seen.add(c)
                k = len(h) // 4 + 1
                w = ordered(h, values)[:k]
                before = np.zeros(k, dtype=np.uint64)
                before[1:] = w[:-1]
                cols.append((w, np.full(k, c, dtype=np.int64), np.full(k, len(h), dtype=np.int64), np.arange(k), before))
                size += k
                if size > 100_000:
                    yield out()
                    cols, size = [], 0
            if len(seen) > SEEN_MAX:
                seen.clear()
        if cols:
            yield out()

    return docs.mapInArrow(run, POSTING)


def changes(cols: dict[str, np.ndarray], keys: tuple[str, ...]) -> np.ndarray:
    """Where a row's keys differ from those of the row before; true for the first."""
    out = np.ones(len(cols[keys[0]]), dtype=bool)
    out[1:] = np.any([cols[k][1:] != cols[k][:-1] for k in keys], axis=0)
    return out


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[dict[str, np.ndarray]]:
    """Batches cut where the (sorted) keys change, so that no run of a key is split."""
    rest: list[dict[str, np.ndarray]] = []
    glue = lambda parts: {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        starts = np.flatnonzero(changes(cols, keys))
        last = int(starts[-1])
        if rest and all(cols[k][0] == rest[-1][k][-1] for k in keys) and not last:
            rest.append(cols)
            continue
        if rest or last:
            yield glue([*rest, {c: v[:last] for c, v in cols.items()}])
        rest = [{c: v[last:] for c, v in cols.items()}]
    if rest:
        yield glue(rest)


CANDIDATE = "a long, b long, w long, place long, before long, leader boolean"


def candidates(posted: DataFrame) -> DataFrame:
    """(a, b) candidate pairs with w null; and the postings of crowded shingles, by class a, with w set.

    ``leader`` marks the postings of the leaders of a shingle that is dealt in blocks: they meet in a round of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in runs(batches, "w", "salt"):
            w, salt, cls, place, before = (g[c] for c in ("w", "salt", "cls", "place", "before"))
            n, at, _ = unpacked(place)
            starts = np.flatnonzero(changes(g, ("w", "salt")))
            size = np.diff(np.append(starts, len(w)))
            few = (size <= SMALL) & (salt[starts] == 0)
            small = np.repeat(few, size)
            a, b, leads = [], [], []
            for k in range(1, min(SMALL, int(size[few].max(initial=1)))):
                i = np.flatnonzero((w[:-k] == w[k:]) & small[:-k] & small[k:])
                i = i[fits(n[i], at[i], n[i + k], at[i + k])]
                i = i[(cls[i] != cls[i + k]) & ~((before[i] == before[i + k]) & (at[i] > 0) & (at[i + k] > 0))]
                a.append(cls[i])
                b.append(cls[i + k])
            crowded = ~small
            for s, m in zip(starts[~few], size[~few], strict=True):
                of = slice(s, s + m)
                most = np.maximum(n[of].min(), -(-3 * n[of] // 4))  # the smallest partner that it may have here
                crowded[of] = (7 * (n[of] - at[of]) >= 3 * (n[of] + most)) | (salt[s] > 0)
                for lead in s + np.argsort(cls[of], kind="stable")[:LEADERS]:
                    ok = fits(n[of], at[of], n[lead], at[lead]) & (cls[of] != cls[lead])
                    a.append(np.full(int(ok.sum()), cls[lead]))
                    b.append(cls[of][ok])
                    if salt[s]:
                        leads.append(lead)
            a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
            a, b = np.minimum(a, b), np.maximum(a, b)
            if len(a):
                a, b = np.unique(np.stack([a, b]), axis=1)
            none, k, leader = pa.nulls(len(a), pa.int64()), int(crowded.sum()), np.zeros(len(w), dtype=bool)
            leader[leads] = True
            yield pa.RecordBatch.from_pydict({"a": a, "b": b, "w": none, "place": none, "before": none, "leader": pa.nulls(len(a), pa.bool_())})
            yield pa.RecordBatch.from_pydict({"a": cls[crowded], "b": pa.nulls(k, pa.int64()), "w": w[crowded], "place": place[crowded], "before": before[crowded], "leader": leader[crowded]})

    dealt = posted.repartition("w", salt_of("place")).withColumn("salt", salt_of("place")).sortWithinPartitions("w", "salt")
    return dealt.mapInArrow(run, CANDIDATE)


def promising(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose sketches leave them a chance, as the classes' smallest doc_ids."""
    side = lambda c: classes.select(F.col("cls").alias(c), F.col("rep").alias(f"rep_{c}"), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")).hint("merge")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "sketch_a", "sketch_b")), strict=True)
            keep = pa.array([7 * apart(x, y) <= n + m for n, m, x, y in rows], pa.bool_())
            found = batch.filter(keep)
            yield pa.RecordBatch.from_pydict({"a": found.column("rep_a"), "b": found.column("rep_b")})

    return pairs.join(side("a"), "a").join(side("b"), "b").drop("a", "b").mapInArrow(run, "a long, b long")


def tiles(crowded: DataFrame, comps: DataFrame) -> DataFrame:
    """Postings of shingles that several neighbourhoods share, with these and sketches, once for each tile of two blocks.

    Where a shingle's postings come in blocks, the join keeps them.
    """
    of = comps.filter("rep IS NOT NULL").select("cls", F.col("component").alias("comp"), "sketch")
    named = written(crowded.withColumn("salt", salt_of("place")).join(of.select("cls", "comp").hint("merge"), "cls"), "crowded")
    shared = named.groupBy("w").agg(F.count("*").alias("m"), F.min("comp").alias("least"), F.max("comp").alias("most"), F.max("salt").alias("salts")).filter("least <> most")
    shared = written(shared.select("w", F.ceil(F.col("m") / TILE).cast("int").alias("blocks"), F.explode(F.sequence(F.lit(0), "salts")).alias("salt")), "shared_shingles")
    rows = named.join(shared.hint("merge"), ["w", "salt"]).join(of.select("cls", "sketch").hint("merge"), "cls")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("w", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "place", "before", "comp", "sketch", "block")


class Unions:
    """Groups of the numbers 0 to m - 1; unite() says whether two were apart."""

    def __init__(self, m: int):
        self.of = np.arange(m)

    def unite(self, i: int, j: int) -> bool:
        a, b = self.of[i], self.of[j]
        if a == b:
            return False
        self.of[self.of == b] = a
        return True


def across(tiled: DataFrame) -> DataFrame:
    """Pairs (a, b) of neighbourhoods to unite: some two of their sets, in one tile, pass the bounds and have a chance by sketch.

    In a tile of two different blocks, pairs within a block are left to that block's own tile.
    """
    keys = ("w", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in runs(batches, *keys):
            starts = np.flatnonzero(changes(g, keys))
            a, b = [], []
            for s, e in zip(starts, np.append(starts[1:], len(g["w"])), strict=True):
                place, before, comp, block, sketches = (g[c][s:e] for c in ("place", "before", "comp", "block", "sketch"))
                n, at, _ = unpacked(place)
                size, levels, inner = np.array([len(x) for x in sketches]), {}, g["low"][s] == g["high"][s]
                known, comp = np.unique(comp, return_inverse=True)
                groups = Unions(len(known))

                def level(width, sketches=sketches, levels=levels):
                    if width not in levels:
                        levels[width] = np.stack([folded(x if len(x) >= width else bytes(width), width) for x in sketches])
                    return levels[width]

                for i in range(e - s - 1):
                    rest = slice(i + 1, None)
                    ok = fits(n[i], at[i], n[rest], at[rest]) & (groups.of[comp[rest]] != groups.of[comp[i]]) & (inner | (block[rest] != block[i]))
                    j = np.flatnonzero(ok & ~((before[rest] == before[i]) & (at[rest] > 0) & (at[i] > 0))) + i + 1
                    width = np.minimum(size[j], size[i])
                    for k in np.unique(width):
                        of = j[width == k]
                        bits = np.bitwise_count(level(k)[of] ^ level(k)[i]).sum(axis=1, dtype=np.int64)
                        for x in np.unique(comp[of[7 * bits <= n[of] + n[i]]]):
                            if groups.unite(comp[i], x):
                                a.append(known[comp[i]])
                                b.append(known[x])
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return tiled.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


class Holders:
    """For runs of elements: how many of them each set holds."""

    def __init__(self, sets: list[np.ndarray]):
        self.m = len(sets)
        every, owner = np.concatenate(sets), np.repeat(np.arange(self.m, dtype=np.int32), [len(x) for x in sets])
        order = np.argsort(every, kind="stable")
        every, self.owner = every[order], owner[order]
        self.values, self.first = np.unique(every, return_index=True)
        self.count = np.diff(np.append(self.first, len(every)))
        often = np.flatnonzero(8 * self.count > max(self.m, 32))  # held by many: a row of marks each
        self.row = np.full(len(self.values), -1)
        self.row[often] = np.arange(len(often))
        self.marks = np.zeros((len(often), self.m), dtype=np.uint8)
        for r, k in enumerate(often):
            self.marks[r, self.owner[self.first[k] : self.first[k] + self.count[k]]] = 1

    def of(self, elements: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.values, elements)
        k = k[self.values[np.minimum(k, len(self.values) - 1)] == elements]
        out, rows = np.zeros(self.m, dtype=np.int64), self.row[k]
        if (rows >= 0).any():
            out += self.marks[rows[rows >= 0]].sum(axis=0, dtype=np.int64)
        k = k[rows < 0]
        if len(k):
            n = self.count[k]
            at = np.arange(n.sum()) + np.repeat(self.first[k] - np.cumsum(n) + n, n)
            out += np.bincount(self.owner[at], minlength=self.m)
        return out


class Sets(NamedTuple):
    """Element arrays in the common order, with the sizes of the sets that they stand for, and what these lack of a common base."""

    elements: list[np.ndarray]
    n: np.ndarray
    lack: np.ndarray

    @staticmethod
    def plain(elements: list[np.ndarray]) -> Sets:
        return Sets(elements, np.array([len(x) for x in elements], dtype=np.int64), np.zeros(len(elements), dtype=np.int64))

    def part(self, at: np.ndarray) -> Sets:
        return Sets([self.elements[i] for i in at], self.n[at], self.lack[at])


def trie_join(owns: Sets, members: Sets, base: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(number of a member, numbers of the owns similar to it), for members with any.

    The members form a trie: they are walked in the order of their paths, and counts stay known at the depth where the
    next path leaves this one. Where no own set can reach the bound with the elements that remain, the subtree is left.
    ``base`` is the size of the common base where the elements are differences from it.
    """
    holders, paths = Holders(owns.elements), members.elements
    need = 3 * owns.n + 7 * owns.lack - 7 * base
    length = np.array([len(x) for x in paths], dtype=np.int64)
    slack = 7 * length - 3 * members.n - 7 * members.lack
    order = sorted(range(len(paths)), key=lambda k: paths[k].astype(">u8").tobytes())

    def common(x: np.ndarray, y: np.ndarray) -> int:
        n = min(len(x), len(y))
        differ = np.flatnonzero(x[:n] != y[:n])
        return int(differ[0]) if len(differ) else n

    stack = [(0, np.zeros(len(owns.n), dtype=np.int64))]
    dead_depth, dead_slack, shared = 0, None, 0
    for place, k in enumerate(order):
        path = paths[k]
        ahead = common(path, paths[order[place + 1]]) if place + 1 < len(order) else 0
        while stack[-1][0] > shared:
            stack.pop()
        if shared < dead_depth:
            dead_slack = None
        shared = ahead
        if dead_slack is not None and slack[k] <= dead_slack:
            continue
        depth, counts = stack[-1]
        if ahead > depth:
            counts = counts + holders.of(path[depth:ahead])
            depth = ahead
            stack.append((depth, counts))
            if not (7 * (counts - depth) + slack[k] >= need).any():
                dead_depth, dead_slack = depth, slack[k]
                continue
        counts = counts + holders.of(path[depth:])
        found = np.flatnonzero(7 * counts >= need + 3 * members.n[k] + 7 * members.lack[k])
        if len(found):
            yield k, found


JOINED = "cls long, links long, rep long, other long, component long, n long, lack long, base long, delta binary"


def tile_links(cls: list[int], rep: list[int], sets: Sets, low: np.ndarray, high: np.ndarray, base: int = 0) -> pa.RecordBatch:
    """Rows (cls, links) for the pairs of a low and a high class (of all classes, if both are the same), and rows
    (cls, 0, rep, other) of links that connect what is connected."""
    inner, degree, groups, edges = low is high, np.zeros(len(cls), dtype=np.int64), Unions(len(cls)), []
    if len(low) and len(high):
        for k, own in trie_join(sets.part(low), sets.part(high), base):
            i, own = high[k], low[own]
            own = own[own != i]
            degree[i] += len(own)
            if not inner:
                degree[own] += 1
            edges += [(i, j) for j in own[groups.of[own] != groups.of[i]] if groups.unite(i, j)]
    k = len(cls) + len(edges)
    none = {c: pa.nulls(k, pa.int64()) for c in ("component", "n", "lack", "base")}
    return pa.RecordBatch.from_pydict(
        {
            "cls": pa.array(cls + [cls[i] for i, _ in edges], pa.int64()),
            "links": pa.array([*degree, *[0] * len(edges)], pa.int64()),
            "rep": pa.array(rep + [rep[i] for i, _ in edges], pa.int64()),
            "other": pa.array([None] * len(cls) + [rep[j] for _, j in edges], pa.int64()),
            **none,
            "delta": pa.nulls(k, pa.binary()),
        }
    )


def joined(docs: DataFrame, comps: DataFrame, heavy: Heavy, clashes: dict[int, int]) -> DataFrame:
    """Rows (cls, links) whose sum is each class's number of links, and rows (cls, 0, rep, other) of links that connect
    what is connected, by the smallest doc_ids of both. Further columns are of large neighbourhoods on their way."""
    shared = docs.sparkSession.sparkContext.broadcast((heavy.values, clashes))
    named = comps.filter("rep IS NOT NULL").select("component", "cls", "rep", "n")
    sizes = named.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("n")).filter("m > 1")
    chunks = F.greatest(F.ceil(F.col("m") / TILE), F.ceil(F.col("n") / TILE_SHINGLES)).cast("int")
    groups = written(sizes.select("component", "m", chunks.alias("chunks")), "neighbourhoods")
    rows = written(join_groups(named.drop("n"), groups, "component", "m").drop("m"), "neighbours")
    few = rows.count() <= FEW_IDS
    first = (F.col("rep") == F.col("component")) & (F.col("chunks") > 1)  # goes to every chunk
    own = F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int")
    placed = rows.select("*", first.alias("first"), own.alias("own"))
    found = docs.join(F.broadcast(placed) if few else placed.hint("merge"), docs["doc_id"] == placed["rep"])
    found = found.withColumn("chunk", F.explode(F.when(F.col("first"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("own"))))
    dealt = found.select("component", "chunk", (~F.col("first")).alias("later"), "cls", "rep", (F.col("chunks") > 1).alias("large"), (F.col("chunk") == F.col("own")).alias("mine"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, clashes = shared.value
        shingler, key, last, cls, rep, sets, base = Shingler(), None, None, [], [], [], None

        def links() -> pa.RecordBatch:
            every = np.arange(len(cls))
            return tile_links(cls, rep, Sets.plain(sets), every, every)

        for batch in batches:
            deltas = []
            for component, chunk, later, c, r, large, mine, text in zip(*(batch.column(x).to_pylist() for x in batch.schema.names), strict=True):
                if (component, chunk) != key:
                    if sets:
                        yield links()
                    key, last, cls, rep, sets, base = (component, chunk), None, [], [], [], None
                h = shingler(text or "")
                if last == c or not len(h) or class_hash(h, clashes) != c:
                    continue  # the doc_id has several rows
                last = c
                if not large:
                    cls.append(c)
                    rep.append(r)
                    sets.append(ordered(h, values))
                    continue
                if base is None and not later:
                    base = h
                if mine:
                    delta = np.setxor1d(base, h, assume_unique=True)
                    lack = (len(delta) + len(base) - len(h)) // 2
                    deltas.append((c, r, component, len(h), lack, len(base), ordered(delta, values).tobytes()))
            if deltas:
                names = ("cls", "rep", "component", "n", "lack", "base")
                cols = {x: pa.array(v, pa.int64()) for x, v in zip(names, [*zip(*deltas, strict=True)][:6], strict=True)}
                none = pa.nulls(len(deltas), pa.int64())
                found = {**cols, "links": none, "other": none, "delta": pa.array([d[6] for d in deltas], pa.binary())}
                yield pa.RecordBatch.from_pydict({x.split()[0]: found[x.split()[0]] for x in JOINED.split(", ")})
        if sets:
            yield links()

    out = written(dealt.repartition("component", "chunk").sortWithinPartitions("component", "chunk", "later", "cls").mapInArrow(run, JOINED), "joined")
    deltas = out.filter("delta IS NOT NULL")
    return out if deltas.isEmpty() else out.filter("delta IS NULL").unionByName(written(large_links(deltas), "joined_large"))


def large_links(deltas: DataFrame) -> DataFrame:
    """As joined(), for classes given by their differences from the first set of their neighbourhood."""
    sizes = deltas.groupBy("component").agg(F.count("*").alias("m"), F.sum(F.octet_length("delta") / 8).alias("n"))
    blocks = F.greatest(F.ceil(F.col("m") / TILE), F.ceil(F.col("n") / TILE_SHINGLES)).cast("int")
    groups = written(sizes.select("component", blocks.alias("blocks")), "large_neighbourhoods")
    few = groups.count() <= FEW_IDS
    rows = deltas.join(F.broadcast(groups) if few else groups.hint("merge"), "component").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ("component", "low", "high")
    dealt = rows.select("component", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "cls", "rep", "n", "lack", "base", "delta")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def links() -> pa.RecordBatch:
            block, cls, rep, n, lack, base, delta = zip(*held, strict=True)
            sets = Sets([np.frombuffer(d, dtype=np.uint64) for d in delta], np.array(n, dtype=np.int64), np.array(lack, dtype=np.int64))
            low = np.flatnonzero(np.array(block) == key[1])
            high = low if key[1] == key[2] else np.flatnonzero(np.array(block) == key[2])
            return tile_links([*cls], [*rep], sets, low, high, base[0])

        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in batch.schema.names), strict=True):
                if row[:3] != key:
                    if held:
                        yield links()
                    key, held = row[:3], []
                held.append(row[3:])
        if held:
            yield links()

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, JOINED)


def classes_of(sets: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(cls, rep, members, n, sketch), and the names that several sets have; these are apart in the classes."""
    classes = lambda rows: rows.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch"), F.min("second").alias("second"), F.max("second").alias("most"))
    found = written(classes(sets), "classes")
    twice = found.filter("second <> most").select("cls", "second").limit(CLASHES_MAX + 1).collect()
    if len(twice) > CLASHES_MAX:
        raise ValueError(f"more than {CLASHES_MAX} classes share their name with another")
    return found.drop("second", "most"), {r.cls: r.second for r in twice}


def renamed(sets: DataFrame, clashes: dict[int, int]) -> DataFrame:
    """The sets with the names that class_hash() gives; unchanged where no name is shared, which is the common case."""
    if not clashes:
        return sets
    known = sets.sparkSession.createDataFrame([*clashes.items()], "cls long, keeps long")
    other = F.col("keeps").isNotNull() & (F.col("keeps") != F.col("second"))
    return sets.join(F.broadcast(known), "cls", "left").withColumn("cls", F.when(other, F.col("second")).otherwise(F.col("cls"))).drop("keeps")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, links): class_id is the smallest doc_id with an equal set, links the
    number of other sets that are similar enough."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profiled = written(profile(docs), "profile")
    sets = profiled.filter("shingle IS NULL").select("doc_id", F.col("n").alias("n_shingles"), "cls", "second", "sketch")
    heavy = heavy_shingles(profiled)
    classes, clashes = classes_of(sets.filter("cls IS NOT NULL"))
    if clashes:
        sets = renamed(sets, clashes)
        classes, _ = classes_of(sets.filter("cls IS NOT NULL"))
    met = written(candidates(postings(docs, heavy, clashes)), "candidates")
    pairs = met.filter("w IS NULL").select("a", "b")
    leaders = met.filter("leader").select("w", F.col("a").alias("cls"), (F.col("place") - salt_of("place")).alias("place"), "before")
    pairs = pairs.unionByName(candidates(leaders).filter("w IS NULL").select("a", "b")).distinct()
    comps = class_components(written(promising(pairs, classes), "pairs"), classes)
    crowded = met.filter("w IS NOT NULL").select("w", F.col("a").alias("cls"), "place", "before")
    if not crowded.isEmpty():
        more = written(across(tiles(crowded, comps)).distinct(), "unions")
        if not more.isEmpty():
            named = components(more).select(F.col("node").alias("component"), F.col("component").alias("united"))
            comps = written(comps.join(named.hint("merge"), "component", "left").withColumn("component", F.coalesce("united", "component")).drop("united"), "neighbourhood_of")
    found = written(joined(docs, comps, heavy, clashes), "joined")
    degrees = found.groupBy("cls").agg(F.sum("links").alias("links"))
    comps = class_components(found.filter("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")), classes)
    groups = written(comps.join(degrees.hint("merge"), "cls", "left").select("cls", "members", "component", "rep", F.coalesce("links", F.lit(0)).alias("links")), "groups")
    linked = join_groups(sets.filter("cls IS NOT NULL").drop("sketch", "second"), groups, "cls", "members")
    cols = ["doc_id", "n_shingles"]
    alone = sets.filter("cls IS NULL").select(*cols, F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    return linked.select(*cols, F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"), F.col("rep").alias("class_id"), "links").unionByName(alone)


def class_components(links: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes with their component; links: (a, b) by smallest doc_ids."""
    joined = classes.join(components(links).hint("merge"), F.col("rep") == F.col("node"), "left")
    return written(joined.withColumn("component", F.coalesce("component", "rep")).drop("node"), "components")


def op4_ngram_join(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "class_id", "links")
