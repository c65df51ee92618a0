"""Ids and decoded texts against the tokenizers library itself, over ordinary and odd texts."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from planlark.llm import bpe_chunks
from tests.llm.texts import SF, document_texts, odd_texts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def expected(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def check(library, texts):
    enc = bpe_chunks.Encoder(PATH)
    for text, (ids, decoded) in zip(texts, enc.encode_many(texts), strict=True):
        want, want_text = expected(library, text)
        got = memoryview(ids).cast("I").tolist()
        assert got == want, repr(text[:300])
        assert decoded == want_text, repr(text[:300])
    return enc


def test_odd_texts_equal_the_library(library):
    check(library, odd_texts())


def test_random_characters_equal_the_library(library):
    draw = random.Random(5)
    pool = "abcXYZ 's't'll  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0  　.,;:!?-_'\"0123éÉßẞİıſḰͅñ漢字あ🙂‍​Σςσ<|endoftext|>"
    check(library, ["".join(draw.choice(pool) for _ in range(draw.randrange(0, 400))) for _ in range(400)])


def test_documents_equal_the_library_and_chunks_are_reused(library):
    enc = check(library, document_texts())
    assert 0 < enc.encoded < enc.met
    assert enc.grown == 0


def test_query_over_small_rows(spark, library):
    rows = [(3, "Hello, World"), (1, None), (2, ""), (2, ""), (7, "a" * 5000), (None, "x y")]
    docs = spark.createDataFrame([(i, t, "fr", 1) for i, t in rows], "doc_id long, text string, key string, ids int")
    got = sorted(map(tuple, bpe_chunks.op2_bpe(spark, docs, PATH).collect()), key=str)
    want = []
    for i, t in rows:
        ids, decoded = expected(library, t or "")
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        want.append((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe_chunks.op2_bpe(spark, docs.limit(0), PATH).count() == 0


def test_query_over_documents(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in bpe_chunks.op2_bpe(spark, docs, PATH).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()}
    for i, t in texts.items():
        ids, _ = expected(library, t)
        assert got[i] == (len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest())


def test_windows_that_do_not_agree_grow(library):
    """A text whose window is falsified is encoded as a whole."""
    enc, text = bpe_chunks.Encoder(PATH), "the quick brown fox jumps over the lazy dog " * 40
    want = library.encode(text, add_special_tokens=False).ids
    enc.encode_many([text])
    for window in enc.windows:
        enc.windows[window] = enc.windows[window][::-1]
    ((ids, _),) = enc.encode_many([text])
    assert [*memoryview(ids).cast("I")] == want
    assert enc.grown == 1


def test_cuts_do_not_depend_on_spans():
    roller, draw = bpe_chunks.Roller(), random.Random(3)
    text = "".join(draw.choice("abcdefgh é🙂") for _ in range(200_000))
    ends, least = roller.cuts(text)
    parts = [roller.cuts(text[a : a + 70_000])[0] for a in range(0, 200_000, 60_000)]
    known = {a + e for a, found in zip(range(0, 200_000, 60_000), parts, strict=True) for e in found[:-1]}
    assert set(ends[:-1]) <= known
    assert ends[-1] == len(text) and least >= 0


def test_reuse_is_measured(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = bpe_chunks.reuse(docs, PATH)
    assert got["distinct"] <= got["encoded"] < got["met"]
    assert got["grown"] == 0
