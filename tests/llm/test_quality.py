"""The quality network: gradients against differences, pooling against every window, held-out accuracy."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from planlark.llm import quality
from tests.llm.texts import odd_texts

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def net():
    out = quality.fresh(0.7, seed=4)
    out.bias += np.linspace(-0.5, 0.5, quality.FILTERS)
    return out


def windows(net, data):
    t = net.tables().astype(float)
    return np.array([sum(t[k][data[i + k]] for k in range(quality.WIDTH)) for i in range(len(data) - quality.WIDTH + 1)])


def slow_probability(net, text):
    """Every window on its own, chunks by their definition."""
    raw = text.encode()
    answers = windows(net, raw + b"\0" * (quality.WIDTH - len(raw)))
    halves = [answers[i : i + quality.HALF].max(axis=0) for i in range(0, len(answers), quality.HALF)]
    pooled = np.array([np.maximum(a, b) for a, b in zip(halves, halves[1:])] or halves)
    live = np.maximum(pooled + net.bias, 0)
    h = np.tanh(np.r_[live.mean(axis=0), live.max(axis=0)] @ net.dense + net.dense_bias)
    return 1 / (1 + np.exp(-(h @ net.out[:-1] + net.out[-1])))


def test_scores_equal_all_windows(net):
    texts = [*odd_texts(), "x" * 5, "é" * 64, "ab" * 67, "".join(chr(97 + i * i % 26) for i in range(20_000))]
    for t in texts:
        assert quality.probability(net, net.tables(), t) == pytest.approx(slow_probability(net, t), abs=1e-5)


def test_last_bytes_of_a_long_text_count(net):
    tables = net.tables()
    text = "plain words " * 30_000
    assert quality.probability(net, tables, text) != quality.probability(net, tables, text + "!!***!!" * 30)


def test_gradients_equal_differences(net):
    rng = np.random.default_rng(0)
    docs = [(rng.integers(0, 256, n).astype(np.uint8), y) for n, y in ((6, 1), (300, 0), (900, 1))]

    def loss(parts):
        now = quality.Network(*parts)
        t, total = now.tables(), 0.0
        for data, y in docs:
            p = quality.top(now, quality.chunks(quality.blocks(data, t)[0].astype(float)))[2]
            total -= np.log(p if y else 1 - p)
        return total / len(docs) + quality.DECAY / 2 * sum((p * p).sum() for p in parts)

    grads = quality.gradients(net, net.tables(), docs)
    for i, g in enumerate(grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        parts = [[p.copy() for p in net.parts()] for _ in range(2)]
        parts[0][i][at] += 1e-3
        parts[1][i][at] -= 1e-3
        assert g[at] == pytest.approx((loss(parts[0]) - loss(parts[1])) / 2e-3, rel=0.05, abs=1e-4)


def test_held_out_accuracy(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    docs = read("documents").join(read("labels").select("doc_id", "quality"), "doc_id", "left_semi")
    got = {r.doc_id: r for r in quality.op12_quality(spark, docs.repartition(4), read("labels")).collect()}
    truth = pq.read_table(f"{SF}/labels.parquet").to_pydict()
    held = [(got[i].score, q) for i, q in zip(truth["doc_id"], truth["quality"], strict=True) if i in got and zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    good, bad = (np.array([s for s, q in held if q == k]) for k in (1, 0))
    auc = (good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2
    assert auc > 0.98
    assert (good >= 0.3).mean() > 0.99 and (bad < 0.3).mean() > 0.75
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "Good words, all of them.", "x"), (1, "Good words, all of them.", "y"), (2, None, "x"), (3, "", "x"), (None, "no id", "x"), (4, "!! " * 300_000, "x"), (5, "漢字", "x"), (6, "bad!! " * 40, "x"), (7, "bad!! " * 50, "x")],
        "doc_id long, text string, data string",
    ).withColumns({"quality": F.lit("q"), "shard": F.lit(1), "score": F.lit(9.0)})
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (5, 1), (2, None), (None, 1), (6, 0), (7, 0), (99, 1)], "doc_id long, quality int").withColumn("text", F.lit("t"))
    once, again = (sorted(quality.op12_quality(spark, d, labels).collect(), key=str) for d in (docs, docs.repartition(5)))
    assert len(once) == 9 and once == again
    assert all(0 <= r.score <= 1 for r in once)
    assert len({r.score for r in once if r.doc_id == 1}) == 1
    assert [r.score for r in once if r.doc_id == 2] == [r.score for r in once if r.doc_id == 3]
    none = quality.op12_quality(spark, docs, labels.filter("quality > 5")).collect()
    assert {r.score for r in none} == {0.5} and len(none) == 9
    good = quality.op12_quality(spark, docs, labels.filter("quality = 1 AND doc_id = 5")).collect()
    assert len({r.score for r in good}) == 1 and good[0].score >= 0.5
    assert quality.op12_quality(spark, docs.limit(0), labels).count() == 0
