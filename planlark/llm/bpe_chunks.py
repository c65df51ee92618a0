"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over 32 code points cuts every text into chunks whose borders depend on content alone, so texts that
share a passage share its chunks. A chunk is encoded once where it is met again; its encoding is kept without the broken
words at its two ends. Joins are repaired by encoding a window anew, by the library: the broken words between two chunks
(over chunks without white space, until there is one) and one whole word on either side. Where the window's ids agree
exactly with those of the two chunks in these whole words, what lies between belongs to the text; where they do not,
the window grows to the whole text.

Why agreement in a whole word is enough: the tokenizer's pattern drops white space and never lets a token cross it, so
ids on either side of an agreed word cannot depend on each other. This is checked on a probe when a tokenizer is loaded.

Dealing: documents are dealt by their smallest chunk hash, so near copies meet in one task and reuse chunks there. A
task that reads more than ``NEAR`` documents with one hash deals the rest by its own number: a group of copies that
holds a third of all rows is spread over as many tasks as read it. The memos of a worker (words, chunks, windows) are
bounded. Sharing is thus within a task (chunks of one document family), not over the cluster: one dictionary for all
chunks would have to move every text and every id once more, beyond the disk that the check tool grants.
``reuse()`` measures what that leaves: chunks, those that a worker encoded, and distinct ones over all documents.

Cases: a null text is empty (no ids, empty decoded text); a text without white space is one window; a text with
separators that Python takes for white space is encoded by the library; very long texts are cut in spans of SPAN code
points; repeated rows are encoded each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import contextlib
import gc
import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlark.llm.common import bounded_batches

WINDOW, MASK = 32, (1 << 8) - 1  # a cut each 256 code points or so
NEAR = 2
SPAN = 1 << 16
#: Bounds of a worker's memos: words, and characters of chunks and windows (some 60 MB in all).
MAX_WORDS, MAX_CHUNK_CHARS = 150_000, 3_000_000
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPACE = re.compile(r"[ \n]")
TAIL = ".,;:!?"
SEPARATORS = "\x1c\x1d\x1e\x1f"  # white space to str.split, not to the tokenizer


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Roller:
    """Rolling hashes of all windows of a text by prefix sums, span by span, and the cuts that they make."""

    def __init__(self):
        self.up, self.down = powers(BASE, SPAN + WINDOW), powers(INVERSE, SPAN + WINDOW)

    def cuts(self, text: str) -> tuple[list[int], int]:
        """Ends of the chunks, and the text's smallest hash at a cut (of the text itself, if it has none)."""
        n, ends, least = len(text), [], None
        for base in range(0, n - WINDOW + 1, SPAN):
            chars = np.frombuffer(text[base : base + SPAN + WINDOW - 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            sums = np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * self.up[: len(chars)])
            windows = sums[WINDOW - 1 :].copy()
            windows[1:] -= sums[: len(chars) - WINDOW]
            hashes = mixed(windows * self.down[: len(windows)])
            at = np.flatnonzero((hashes & np.uint64(MASK)) == 0)
            if len(at):
                ends += (base + at + WINDOW).tolist()
                low = int(hashes[at].min() >> np.uint64(1))
                least = low if least is None else min(least, low)
        if n and (not ends or ends[-1] != n):
            ends.append(n)
        return ends, hash_of(text) if least is None else least


def hash_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1


def byte_names() -> dict[int, str]:
    """How byte-level models name bytes: printable ones by themselves, the others by code points from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


BYTE_NAMES = byte_names()


def is_plain(word: str) -> bool:
    """Letters up to U+012F alone: one piece for the patterns here, and in composed form."""
    return word.isalpha() and max(word) < "\u0130"


def ids_of_piece(model, piece: str) -> list[int]:
    """Ids of one piece (letters, perhaps after a space) by the library's model itself, without the steps that would find it again."""
    space, word = (BYTE_NAMES[32], piece[1:]) if piece[0] == " " else ("", piece)
    return [t.id for t in model.tokenize(space + (word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_NAMES)))]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path) as f:
            if json.load(f).get("decoder") is not None:
                raise ValueError("a tokenizer without a decoder is needed")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        whole, parts = self.library("ab c.\nd 'e"), [self.library(x) for x in ("ab", "c.", "d", "'e")]
        if whole != [i for p in parts for i in p]:
            raise ValueError("a tokenizer whose tokens end at white space is needed")
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.model = self.tokenizer.model
        self.words: dict[str, tuple[bytes, str]] = {}
        self.chunks: dict[str, Chunk] = {}
        self.windows: dict[str, array] = {}
        self.held, self.met, self.encoded, self.grown = 0, 0, 0, 0
        self.roller = Roller()

    def library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn(self, words: set[str]) -> None:
        """Encode the words that the memo lacks, each once, in one call.

        The tokenizer cuts between a letter and the mark after it, and drops case, so a word is asked for without both.
        """
        known, names = self.words, self.names
        cut, ask = [], set()
        for w in words - known.keys():
            mark = w[-1]
            rest = w[:-1] if mark in TAIL and w[-2:-1].isalpha() and w[-2] != "\u0130" else w  # its lower case ends with a mark
            if is_plain(rest):
                rest = rest.lower()
            cut.append((w, rest, mark))
            ask.add(rest)
        ask.update(TAIL)
        asked = [*(ask - known.keys())]
        other = [p for p in asked if not is_plain(p)]
        ids_of = dict(zip(other, [e.ids for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)] if other else (), strict=True))
        for p in asked:
            ids = ids_of[p] if p in ids_of else ids_of_piece(self.model, p)
            known[p] = (array("I", ids).tobytes(), " ".join([names[i] for i in ids]))
        for w, rest, mark in cut:
            if w not in known:
                a = known[rest]
                if len(rest) < len(w):
                    b = known[mark]
                    a = (a[0] + b[0], a[1] + " " + b[1])
                known[w] = a

    def chunked(self, text: str) -> list[str]:
        ends, _ = self.roller.cuts(text)
        return [text[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905

    def prepare(self, text: str) -> Chunk:
        first = SPACE.search(text)
        if first is None:
            return Chunk(text, "", None, "", "", None, None)
        last = max(text.rfind(" "), text.rfind("\n"))
        inner = text[first.start() : last + 1]
        words = inner.split()
        if not words:
            return Chunk(text[: first.start()], text[last + 1 :], words, inner, inner, None, None)
        left, right = inner[: inner.index(words[0]) + len(words[0])], inner[inner.rindex(words[-1]) :]
        return Chunk(text[: first.start()], text[last + 1 :], words, left, right, None, None)

    def repaired(self, left: Chunk | None, glue: str, right: Chunk | None, window: str) -> array | None:
        """Ids of the glue between two chunks, from its window; None where the window does not agree with them."""
        ids, known = self.windows[window], self.words
        before = known[left.words[-1]][0] if left is not None and left.words else b""
        after = known[right.words[0]][0] if right is not None and right.words else b""
        raw = ids.tobytes()
        if len(before) + len(after) > len(raw) or not raw.startswith(before) or not raw.endswith(after):
            return None
        return ids[len(before) // 4 : len(ids) - len(after) // 4]

    def whole(self, text: str) -> tuple[bytes, str]:
        ids = self.library(text)
        return array("I", ids).tobytes(), " ".join([self.names[i] for i in ids])

    def encode_many(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
        if self.held > MAX_CHUNK_CHARS:
            self.chunks, self.windows, self.held = {}, {}, 0
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        plans, fresh = [], {}
        for text in texts:
            if any(c in text for c in SEPARATORS):
                plans.append(None)
                continue
            found = []
            for c in self.chunked(text):
                chunk = self.chunks.get(c)
                if chunk is None:
                    chunk = self.chunks[c] = fresh[c] = self.prepare(c)
                    self.held += len(c) + 300
                found.append(chunk)
            self.met += len(found)
            plans.append(joins(found))
        self.encoded += len(fresh)
        words = {w for c in fresh.values() if c.words for w in c.words}
        windows = {w for joined in plans if joined for _, _, _, w in joined if w and w not in self.windows}
        words.update(side.words[k] for joined in plans if joined for left, _, right, _ in joined for side, k in ((left, -1), (right, 0)) if side is not None and side.words)
        self.learn(words)
        asked = [*windows]
        for w, e in zip(asked, self.tokenizer.encode_batch_fast(asked, add_special_tokens=False) if asked else (), strict=True):
            self.windows[w] = array("I", e.ids)
            self.held += len(w) + 200
        known = self.words
        for c in fresh.values():
            if c.words is not None:
                pairs = [known[w] for w in c.words]
                c.ids, c.names = b"".join([p[0] for p in pairs]), " ".join([p[1] for p in pairs if p[1]])
        return [self.whole(text) if joined is None else self.assembled(text, joined) for text, joined in zip(texts, plans, strict=True)]

    def assembled(self, text: str, joined: list) -> tuple[bytes, str]:
        ids, names, every = [], [], self.names
        for left, glue, right, window in joined:
            if window:
                between = self.repaired(left, glue, right, window)
                if between is None:
                    self.grown += 1
                    return self.whole(text)
                ids.append(between.tobytes())
                names.append(" ".join([every[i] for i in between]))
            if right is not None:
                ids.append(right.ids)
                names.append(right.names)
        return b"".join(ids), " ".join(filter(None, names))


class Chunk:
    """Broken words at both ends, the whole words between (None where there is no white space), with the margins that
    windows take in, and their encoding."""

    __slots__ = ("head", "tail", "words", "left", "right", "ids", "names")

    def __init__(self, *parts):
        self.head, self.tail, self.words, self.left, self.right, self.ids, self.names = parts


def joins(chunks: list[Chunk]) -> list[tuple[Chunk | None, str, Chunk | None, str]]:
    """(chunk before, broken words, chunk after, window) of each join; the ends of a text are joins with nothing."""
    out, before, glue = [], None, ""
    for c in chunks:
        glue += c.head
        if c.words is not None:
            out.append((before, glue, c, (before.right if before else "") + glue + c.left if glue else ""))
            before, glue = c, c.tail
    out.append((before, glue, None, (before.right if before else "") + glue if glue else ""))
    return out


@contextlib.contextmanager
def no_cycles():
    """Without the cycle collector: it would walk the memos again and again, and they hold no cycles."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a worker process, so that the memos outlive a task."""
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def groups_of(batch: pa.RecordBatch, most: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batch in pieces of bounded text."""
    found = [t or "" for t in batch.column("text").to_pylist()]
    start = size = 0
    for k, t in enumerate(found):
        size += len(t)
        if size >= most or k == len(found) - 1:
            yield batch.slice(start, k + 1 - start), found[start : k + 1]
            start, size = k + 1, 0


def dealt(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text), dealt so that documents that share chunks meet."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, seen, own = Roller(), {}, TaskContext.get().partitionId()
        for batch in batches:
            key, salt = [], []
            for t in batch.column("text").to_pylist():
                k = roller.cuts(t or "")[1]
                seen[k] = seen.get(k, 0) + 1
                key.append(k)
                salt.append(0 if seen[k] <= NEAR else own + 1)
            if len(seen) > 200_000:
                seen.clear()
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": batch.column("text"), "key": pa.array(key, pa.int64()), "salt": pa.array(salt, pa.int32())})

    bounded_batches(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(keys, "doc_id long, text string, key long, salt int")
    return keyed.repartition("key", "salt").select("doc_id", "text")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): ids as array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for rows, found in groups_of(batch):
                with no_cycles():
                    got = enc.encode_many(found)
                ids = pa.array([np.frombuffer(i, dtype="<i4") for i, _ in got], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), "ids": ids, "decoded": pa.array([d for _, d in got], pa.string())})

    return dealt(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): as encoded(), with digests taken where the ids are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for rows, found in groups_of(batch):
                with no_cycles():
                    got = enc.encode_many(found)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": rows.column("doc_id"),
                        "n_tokens": pa.array([len(i) // 4 for i, _ in got], pa.int64()),
                        "ids_sha256": [hashlib.sha256(i).hexdigest() for i, _ in got],
                        "decoded_sha256": [hashlib.sha256(d.encode()).hexdigest() for _, d in got],
                    }
                )

    return dealt(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def reuse(docs: DataFrame, path: str) -> dict[str, int]:
    """Chunks met in all texts, those that workers encoded, distinct ones, and texts whose windows grew to the whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path)
        for batch in batches:
            for _, found in groups_of(batch):
                met, encoded, grown = enc.met, enc.encoded, enc.grown
                enc.encode_many(found)
                hashes = [hash_of(c) for t in found for c in enc.chunked(t)]
                yield pa.RecordBatch.from_pydict({"met": [enc.met - met], "encoded": [enc.encoded - encoded], "grown": [enc.grown - grown], "hashes": pa.array([hashes], pa.list_(pa.int64()))})

    counted = dealt(docs).mapInArrow(run, "met long, encoded long, grown long, hashes array<long>")
    sums = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("met", "encoded", "grown")]).first()
    return {**sums.asDict(), "distinct": counted.select(F.explode("hashes").alias("h")).distinct().count()}


def op2_bpe(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    return digests(docs, path)
