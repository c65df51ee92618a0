"""Token ids in files, compressed by a static range asymmetric numeral system.

One table of symbol frequencies, counted over all documents, is shared by all files. A file holds the ids of
consecutive documents (ascending doc_id) as blocks that decode independently: a block interleaves up to LANES lanes,
lane j taking every LANES-th id from j on, so a step codes one id of each lane at once. Checkpoints inside a block (the
lanes' states and the place in its words, each EVERY steps) let a reader start there; each block has a checksum over
its ids and one over its words.

Flow: documents are encoded once and their ids written as a table (16 bits an id); ids are counted (the counts, one a
vocabulary entry, come to the driver); the table is dealt by ranges of doc_id and each task writes files of ROLL ids.
Running sums over the files' sizes give each file's first place, which becomes its name. The folder needs nothing else to
be read: shares.bin is the table of frequencies, each file holds that table's checksum, its documents' ids and sizes,
and its name says where it begins. Files are read back by Spark's binary file source, decoded and checked in tasks.

Cases: a null text is empty and still has the end id; a null doc_id comes first; rows with one doc_id keep one order
(by their ids) and are reported each; an empty table gives no file and no row; further columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planlark.llm.bpe_chunks import BYTE_NAMES, no_cycles
from planlark.llm.common import bounded_batches, get_file, move_file, put_file, work_path, written

LANES, BLOCK, EVERY, ROLL = 1024, 1 << 18, 128, 1 << 22
SCALE = 20
LOW = np.uint64(1 << 31)
MAGIC = b"PLRANS02"
END = 0
#: What a piece may end with besides its letters: one run of marks, which the pattern cuts off.
MARKS = "!#$%&*+,-./:;=?@^_~"
#: Letters up to U+012F, perhaps after a space and before marks that are cut off: one piece for the pattern.
WORD = r"^ ?[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}]+$"
#: The byte-level names of the characters of such words.
NAMES = {c: c.encode().decode("latin-1").translate(BYTE_NAMES) for c in map(chr, range(0x130))}
#: Bytes that a white space character cannot end with (of one byte), or begin with.
SOLID = np.array([33 <= b != 127 for b in range(256)])
BEGINS = SOLID & ~np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
#: Bytes that a worker's memo of pieces may take, by MEMO_ENTRY for an entry besides its characters; then pieces of more
#: than SHORT characters go, and all of them if that is not half.
MEMO_BYTES, MEMO_ENTRY, SHORT = 300 << 20, 190, 9


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces that no token crosses begin in texts of UTF-8: at a text, at a space or line end after another
    character, and after a line end that stands alone (of several, the last is a token of its own before a letter)."""
    near = np.concatenate([np.full(3, 32, np.uint8), data, np.full(1, 32, np.uint8)])  # data[i] is near[i + 3]
    at = np.flatnonzero((data == 32) | (data == 10))
    before = near[at + 2]
    wide = (before >= 128) & ((near[at + 1] == 0xC2) | ((near[at] >= 0xE1) & (near[at] <= 0xE3)))  # it may be white space too
    at = at[SOLID[before] & ~wide]
    line = at[(data[at] == 10) & BEGINS[near[at + 4]]]
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[at] = begins[line + 1] = begins[offsets] = True
    begins[-1] = False
    return np.flatnonzero(begins)


def strings(column: pa.Array) -> list[str]:
    """The column as a list; one text that is split is faster to make than many."""
    found = column.buffers()[2].to_pybytes() if len(column) else b""
    if b"\0" in found:
        return column.to_pylist()
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column.cast(pa.string())), "\0")
    return joined[0].as_py().split("\0")


def taken(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The ids of items by their codes, where ``ids`` holds those of all items, one after the other."""
    each = sizes[codes]
    ends = np.cumsum(each)
    return ids[np.repeat((np.cumsum(sizes) - sizes)[codes] - ends + each, each) + np.arange(ends[-1] if len(ends) else 0)]


class Pieces:
    """Ids of texts by the tokenizer, each distinct piece encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.memo: dict[str, bytes] = {}
        self.held = 0

    def learn(self, words: list[str], others: list[str]) -> Iterator[bytes]:
        """Ids of pieces that the memo lacks, the words first; a word needs no pattern."""
        tokenize = self.model.tokenize
        for p in words:
            named = ("\u0120" + p[1:] if p[0] == " " else p) if p.isascii() else "".join([NAMES[c] for c in p])
            self.memo[p] = v = array("H", [t.id for t in tokenize(named)]).tobytes()
            yield v
        for p, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False) if others else (), strict=True):
            self.memo[p] = v = array("H", e.ids).tobytes()
            yield v
        self.held += sum(map(len, words)) + sum(map(len, others)) + MEMO_ENTRY * (len(words) + len(others))

    def known(self, keys: list[str], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct keys, one after the other, and their numbers; those that the memo lacks are learnt."""
        if self.held > MEMO_BYTES:
            self.memo = {p: v for p, v in self.memo.items() if len(p) <= SHORT}
            self.held = len(self.memo) * (MEMO_ENTRY + SHORT)
            if self.held > MEMO_BYTES // 2:
                self.memo, self.held = {}, 0
        found = [*map(self.memo.get, keys)]
        gaps = np.array([i for i, v in enumerate(found) if v is None], dtype=np.int64)
        first, then = gaps[words[gaps]].tolist(), gaps[~words[gaps]].tolist()
        for i, v in zip(first + then, self.learn([keys[i] for i in first], [keys[i] for i in then]), strict=True):
            found[i] = v
        return np.frombuffer(b"".join(found), dtype="<u2"), np.fromiter(map(len, found), np.int64, len(found)) // 2

    def of_distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after the other, and their numbers: a word's marks are asked for apart."""
        bare = pc.ascii_rtrim(pieces, characters=MARKS)
        words = pc.match_substring_regex(bare, WORD).to_numpy(zero_copy_only=False)
        offsets = np.frombuffer(pieces.buffers()[1], dtype="<i8")[: len(pieces) + 1]
        cuts = np.empty(2 * len(pieces) + 1, dtype=np.int64)
        cuts[::2] = offsets
        cuts[1::2] = np.where(words, offsets[:-1] + pc.binary_length(bare).to_numpy(), offsets[1:])
        parts = pa.LargeStringArray.from_buffers(2 * len(pieces), pa.py_buffer(cuts), pieces.buffers()[2]).dictionary_encode()
        codes, is_word = parts.indices.to_numpy(), np.zeros(len(parts.dictionary), dtype=bool)
        is_word[codes[::2][words]] = True
        ids, sizes = self.known(strings(parts.dictionary), is_word)
        return taken(ids, sizes, codes), sizes[codes].reshape(-1, 2).sum(axis=1)

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and where each text's begin and the last's end."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], dtype="<i8")[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
        if offsets[-1] == offsets[0]:
            return np.zeros(0, dtype="<u2"), np.zeros(len(offsets), dtype=np.int64)
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        starts = piece_starts(data, offsets)
        coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)).dictionary_encode()
        ids, sizes = self.of_distinct(coded.dictionary)
        codes = coded.indices.to_numpy()
        at = np.concatenate([[0], np.cumsum(sizes[codes])])
        return taken(ids, sizes, codes), at[np.searchsorted(starts, offsets)]

    def ids(self, texts: list[str]) -> list[bytes]:
        ids, at = self.encoded(pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


PIECES: dict[str, Pieces] = {}


def token_table(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): ids as 16-bit little-endian integers with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PIECES.setdefault(path, Pieces(path)) if path not in PIECES else PIECES[path]
        for batch in batches:
            with no_cycles():
                ids, at = pieces.encoded(batch.column("text"))
            ids, at = np.insert(ids, at[1:], END), at + np.arange(len(at))  # each text's end id
            binary = pa.BinaryArray.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer((2 * at).astype("<i4")), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": binary})

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def ids_in(column: pa.Array) -> np.ndarray:
    """The ids of all rows of a batch, one after the other; no row is null."""
    if not len(column):
        return np.zeros(0, dtype="<u2")
    wide = 8 if pa.types.is_large_binary(column.type) else 4
    at = np.frombuffer(column.buffers()[1], dtype=f"<i{wide}")
    first, last = int(at[column.offset]), int(at[column.offset + len(column)])
    return np.frombuffer(column.buffers()[2], dtype="<u2", count=(last - first) // 2, offset=first)


def counted(tokens: DataFrame) -> np.ndarray:
    """How often each of the 65,536 possible ids occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            sums += np.bincount(ids_in(batch.column("ids")), minlength=1 << 16)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"id": pa.array(at.astype(np.int32)), "n": pa.array(sums[at])})

    out = np.zeros(1 << 16, dtype=np.int64)
    for r in tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Shares of 2**SCALE, at least 1 for each id that occurs."""
    total, live = counts.sum(), np.flatnonzero(counts)
    share = np.zeros(len(counts), dtype=np.int64)
    share[live] = np.maximum(1, counts[live] * ((1 << SCALE) - len(live)) // total)
    share[live[np.argmax(counts[live])]] += (1 << SCALE) - share.sum()
    return share


class Table:
    def __init__(self, share: np.ndarray):
        self.share = share.astype(np.uint64)
        self.crc = zlib.crc32(share.astype("<u4").tobytes())
        self.first = (np.cumsum(share) - share).astype(np.uint64)
        self.limit = self.share << np.uint64(63 - SCALE)
        self.symbol = np.repeat(np.arange(len(share), dtype=np.uint16), share)


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    lanes = int(min(LANES, max(1, len(ids) // 64)))
    steps = -(-len(ids) // lanes)
    state = np.full(lanes, LOW, dtype=np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, int, bytes]] = []
    n_words = 0
    share, limit, first = table.share[ids], table.limit[ids], table.first[ids]
    for s in range(steps - 1, -1, -1):
        here = slice(s * lanes, (s + 1) * lanes)
        f = share[here]
        x = state[: len(f)]
        over = np.flatnonzero(x >= limit[here])
        out = x[over]
        words.append(out.astype(np.uint32))
        n_words += len(out)
        x[over] = out >> np.uint64(32)
        q = x // f
        x += q * (np.uint64(1 << SCALE) - f) + first[here]  # (q << SCALE) + (x - q * f) + first
        if s and s % EVERY == 0:
            marks.append((s, n_words, state.tobytes()))
    stream = np.concatenate(words[::-1]).astype("<u4").tobytes() if words else b""
    held = b"".join(struct.pack("<II", s, n_words - w) + st for s, w, st in reversed(marks))
    head = struct.pack("<IIIIII", len(ids), lanes, len(marks), n_words, zlib.crc32(ids.astype("<u2").tobytes()), zlib.crc32(stream))
    return head + state.astype("<u8").tobytes() + held + stream


def decode_block(data: memoryview, table: Table, from_mark: int = -1) -> tuple[np.ndarray, int]:
    """The block's ids (from a checkpoint on, if one is given), and its length in bytes."""
    n, lanes, n_marks, n_words, ids_crc, words_crc = struct.unpack_from("<IIIIII", data)
    at = 24 + 8 * lanes
    state = np.frombuffer(data, dtype="<u8", count=lanes, offset=24).astype(np.uint64)
    size = 8 + 8 * lanes
    stream_at = at + n_marks * size
    stream = data[stream_at : stream_at + 4 * n_words]
    if zlib.crc32(stream) != words_crc:
        raise ValueError("damaged block")
    words = np.frombuffer(stream, dtype="<u4").astype(np.uint64)
    begin = k = 0
    if from_mark >= 0:
        begin, k = struct.unpack_from("<II", data, at + from_mark * size)
        state = np.frombuffer(data, dtype="<u8", count=lanes, offset=at + from_mark * size + 8).astype(np.uint64)
    out = np.empty(n, dtype=np.uint16)
    slots = np.uint64((1 << SCALE) - 1)
    for s in range(begin, -(-n // lanes)):
        x = state[: min(lanes, n - s * lanes)]
        slot = x & slots
        sym = table.symbol[slot]
        out[s * lanes : s * lanes + len(x)] = sym
        x = table.share[sym] * (x >> np.uint64(SCALE)) + slot - table.first[sym]
        low = np.flatnonzero(x < LOW)
        x[low] = (x[low] << np.uint64(32)) | words[k : k + len(low)]
        k += len(low)
        state[: len(x)] = x
    out = out[begin * lanes :]
    if from_mark < 0 and zlib.crc32(out.astype("<u2").tobytes()) != ids_crc:
        raise ValueError("ids do not match their checksum")
    return out, stream_at + 4 * n_words


def encode_file(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray, table: Table) -> bytes:
    blocks = [encode_block(ids[a : a + BLOCK], table) for a in range(0, len(ids), BLOCK)]
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    index = known.tobytes() + np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + np.array(sizes, dtype="<i8").tobytes()
    head = MAGIC + struct.pack("<QQII", len(doc_ids), len(blocks), zlib.crc32(index), table.crc)
    return head + index + np.array([len(b) for b in blocks], dtype="<u8").tobytes() + b"".join(blocks)


def decode_file(data: bytes, table: Table) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document; a block is decoded when the documents reach it."""
    view = memoryview(data)
    if bytes(view[:8]) != MAGIC:
        raise ValueError("not a file of this format")
    n, n_blocks, crc, table_crc = struct.unpack_from("<QQII", view, 8)
    if table_crc != table.crc:
        raise ValueError("not the table of this file")
    index = view[32 : 32 + 17 * n]
    if zlib.crc32(index) != crc:
        raise ValueError("damaged index")
    known, doc_ids, sizes = np.frombuffer(index[:n], np.uint8), np.frombuffer(index[n : 9 * n], "<i8"), np.frombuffer(index[9 * n :], "<i8")
    at = 32 + 17 * n + 8 * n_blocks
    held, left = [], 0
    for k in range(n):
        while left < sizes[k]:
            ids, length = decode_block(view[at:], table)
            held.append(ids)
            left += len(ids)
            at += length
        have = np.concatenate(held) if len(held) != 1 else held[0]
        yield (int(doc_ids[k]) if known[k] else None), have[: sizes[k]]
        held, left = [have[sizes[k] :]], left - int(sizes[k])


def write_files(tokens: DataFrame, share: np.ndarray, path: str) -> DataFrame:
    """Files below ``path``, named by their first places; returns the manifest (file, n_ids, start)."""
    put_file(f"{path}/shares.bin", share.astype("<u4").tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, seq = Table(share), TaskContext.get().partitionId(), 0
        doc_ids, sizes, held, n = [], [], [], 0

        def done() -> pa.RecordBatch:
            name = f"part-{part:06d}-{seq:05d}.part"
            put_file(f"{path}/{name}", encode_file(doc_ids, sizes, np.frombuffer(b"".join(held), dtype="<u2"), table))
            return pa.RecordBatch.from_pydict({"file": [name], "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_ids": pa.array([n], pa.int64())})

        for batch in batches:
            for d, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                doc_ids.append(d)
                sizes.append(len(ids) // 2)
                held.append(ids)
                n += sizes[-1]
                if n >= ROLL:
                    yield done()
                    doc_ids, sizes, held, n, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield done()

    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    manifest = written(ordered.mapInArrow(run, "file string, part int, seq int, n_ids long"), "rans_manifest")
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each task that wrote
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    own = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    placed = manifest.withColumn("own", own).join(parts, "part").select("file", "n_ids", (F.col("base") + F.col("own")).alias("start"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [f"{start:020d}.rans" for start in batch.column("start").to_pylist()]
            for old, new in zip(batch.column("file").to_pylist(), names, strict=True):
                move_file(f"{path}/{old}", f"{path}/{new}")
            yield pa.RecordBatch.from_pydict({"file": names, "n_ids": batch.column("n_ids"), "start": batch.column("start")})

    return written(placed.mapInArrow(name, "file string, n_ids long, start long"), "rans_files")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the folder alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            table = table or Table(np.frombuffer(get_file(f"{path}/shares.bin"), dtype="<u4").astype(np.int64))
            for name, data in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                docs, places, sizes, crcs, at = [], [], [], [], int(name.removesuffix(".rans"))
                for d, ids in decode_file(data.as_py(), table):
                    docs.append(d)
                    places.append(at)
                    sizes.append(len(ids))
                    crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    at += len(ids)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "start": pa.array(places, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.rans").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_rans(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    tokens = written(token_table(docs, path), "tokens")
    share = frequencies(counts) if (counts := counted(tokens)).any() else np.zeros(1 << 16, dtype=np.int64)
    if not share.any():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = work_path(spark, "rans")
    write_files(tokens, share, files)
    return read_files(spark, files)
