"""The rANS store: ids against the library, exact round trips, checkpoints and damage."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from planlark.llm import rans_store
from planlark.llm.common import work_path
from tests.llm.texts import SF, document_texts, odd_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def check(library, texts):
    for text, ids in zip(texts, rans_store.Pieces(PATH).ids(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u2").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text[:300])


def test_ids_equal_the_library(library):
    check(library, odd_texts())
    check(library, document_texts())
    draw = random.Random(7)
    pool = "abcXYZ 's't'll  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0  　.,;:!?-_'\"0123éÉßẞİıſ́ñ漢字あ🙂‍​\0<|endoftext|>"
    check(library, ["".join(draw.choice(pool) for _ in range(draw.randrange(0, 300))) for _ in range(400)])


def test_white_space_of_all_kinds_ends_no_piece_too_early(library):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    check(library, [f"{a}b{x}{y}c{x}{x}\u00e9{y}\ud55c{x}" for x in spaces for y in (" ", "\n", "  ", "\n\n", " \n") for a in ("", y, "d")])


def test_a_word_is_encoded_once_whatever_marks_follow(library):
    pieces, texts = rans_store.Pieces(PATH), ["Ein wort, wort&&& wort!!\nwort's", None, "", " wort... d\u00e9j\u00e0*** wort"]
    ids, at = pieces.encoded(rans_store.pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert sorted(pieces.memo) == sorted(["", "Ein", " wort", ",", "&&&", "!!", "\n", "wort's", "...", " d\u00e9j\u00e0", "***"])
    part = rans_store.pa.array(texts).slice(2)  # of a batch whose buffers begin elsewhere
    assert pieces.encoded(part)[0].tolist() == library.encode(texts[3], add_special_tokens=False).ids


def test_ids_are_counted_by_batches(spark):
    rows = [bytearray(np.array([i % 5, 7], "<u2").tobytes()) for i in range(900)]
    column = rans_store.pa.array([bytes(r) for r in rows], rans_store.pa.binary())
    assert rans_store.ids_in(column.slice(3, 4)).tolist() == [3, 7, 4, 7, 0, 7, 1, 7]
    assert rans_store.ids_in(column.slice(0, 0)).tolist() == []
    got = rans_store.counted(spark.createDataFrame([(r,) for r in rows], "ids binary").coalesce(1))
    assert {i: got[i] for i in np.flatnonzero(got).tolist()} == {**dict.fromkeys(range(5), 180), 7: 900}


def table_of(ids):
    return rans_store.Table(rans_store.frequencies(np.bincount(ids, minlength=1 << 16)))


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 1000, 70_000, 300_000])
def test_blocks_round_trip(n):
    draw = np.random.default_rng(n)
    ids = (draw.zipf(1.3, n) % 50_257).astype(np.uint16)
    table = table_of(ids)
    data = rans_store.encode_block(ids, table)
    out, length = rans_store.decode_block(memoryview(data), table)
    assert length == len(data)
    assert (out == ids).all()
    lanes, marks = np.frombuffer(data, "<u4", 2, offset=4)
    for k in range(marks):
        part, _ = rans_store.decode_block(memoryview(data), table, from_mark=k)
        assert (part == ids[(k + 1) * rans_store.EVERY * int(lanes) :]).all()


def test_damage_is_found():
    ids = np.arange(5000, dtype=np.uint16) % 700
    table = table_of(ids)
    data = bytearray(rans_store.encode_block(ids, table))
    data[-3] ^= 1
    with pytest.raises(ValueError, match="damaged|checksum"):
        rans_store.decode_block(memoryview(bytes(data)), table)
    whole = bytearray(rans_store.encode_file([1, None], [3000, 2000], ids, table))
    assert [(d, len(x)) for d, x in rans_store.decode_file(bytes(whole), table)] == [(1, 3000), (None, 2000)]
    whole[34] ^= 1
    with pytest.raises(ValueError, match="damaged index"):
        list(rans_store.decode_file(bytes(whole), table))


def test_a_single_symbol_and_compression():
    ids = np.zeros(100_000, dtype=np.uint16)
    table = table_of(ids)
    data = rans_store.encode_block(ids, table)
    assert (rans_store.decode_block(memoryview(data), table)[0] == 0).all()
    draw = np.random.default_rng(3).zipf(1.5, 200_000) % 50_000
    skewed = draw.astype(np.uint16)
    assert len(rans_store.encode_block(skewed, table_of(skewed))) < skewed.nbytes * 0.6


def expected(library, rows):
    at, out = 0, []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def test_query_over_small_rows(spark, library):
    rows = [(None, "null id first"), (1, None), (2, ""), (5, "Hello, World"), (9, "a" * 4000)]
    docs = spark.createDataFrame([(i, t, 4, "z") for i, t in reversed(rows)], "doc_id long, text string, ids int, file string")
    got = sorted(map(tuple, rans_store.op9_rans(spark, docs, PATH).collect()), key=lambda r: r[1])
    assert got == expected(library, rows)
    assert rans_store.op9_rans(spark, docs.limit(0), PATH).count() == 0
    twice = docs.filter("doc_id = 5").union(docs.filter("doc_id = 5"))
    starts = sorted(r.start for r in rans_store.op9_rans(spark, twice, PATH).collect())
    assert starts == [0, expected(library, [(5, "Hello, World")])[0][2]]


def test_query_over_documents(spark, library, monkeypatch):
    monkeypatch.setattr(rans_store, "ROLL", 20_000)  # several files a task
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, rans_store.op9_rans(spark, docs, PATH).collect()))
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert got == expected(library, rows)


def test_files_alone_give_the_ids(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tokens = rans_store.token_table(docs, PATH)
    share = rans_store.frequencies(rans_store.counted(tokens))
    assert share.sum() == 1 << rans_store.SCALE
    path = work_path(spark, "rans-test")
    manifest = rans_store.write_files(tokens, share, path)
    total = manifest.agg({"n_ids": "sum"}).first()[0]
    assert rans_store.read_files(spark, path).agg({"n_tokens": "sum"}).first()[0] == total
