"""The corpus pipeline: each stage against a plain version over its own input."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from planlark.llm import toxicity
from planlark.llm.common import table
from tests.llm.test_ngram import brute
from tests.llm.texts import SF


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_stages(spark, tmp_path):
    docs, seen = table(spark, SF, "documents"), {}
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        seen[name] = (docs, docs := spark.read.parquet(str(tmp_path / name)))
        assert name == pipeline.STAGES[-1][0] or docs.columns == columns

    before, after = map(rows_of, seen["toxicity"])
    lexicon = toxicity.fit(toxicity.labelled(table(spark, SF, "documents"), table(spark, SF, "labels"), 20_000))
    assert sorted(after) == sorted(r for r in before if lexicon.score(r[1] or "") < 0.5)

    before, after = map(rows_of, seen["exact_dedup"])
    best = {}
    for r in before:
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")
        best[key] = max(best.get(key, r), r)
    assert sorted(after) == sorted(best.values())

    before, after = map(rows_of, seen["ngram_join"])
    kept = {i for i, _, c in brute([r[:2] for r in before]) if i == c}
    assert sorted(after) == sorted(r for r in before if r[0] in kept)

    before, after = map(rows_of, seen["mixing"])
    assert set(after) == set(before)  # no document goes
    assert len(after) >= len(before)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    want = sorted((i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in after)
    assert sorted((r.doc_id, tuple(r.ids)) for r in docs.collect()) == want


def test_empty_documents(spark, tmp_path):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() == 0


def test_nulls_and_further_columns(spark, tmp_path):
    rows = [(1, None, None, None, 0, "z"), (2, "", "en", "web", 0, "z"), (None, "a b c d e f", "en", "web", 11, "z"), (4, "a b c d e f", "de", None, 11, None), (4, "a b c d e f", "de", None, 11, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, cls string")
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "cls"]
    assert {r.text or "" for r in docs.collect()} == {"", "a b c d e f"}
