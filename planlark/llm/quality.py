"""Document quality by a small convolutional network over bytes, in numpy.

A text's UTF-8 bytes are read by FILTERS filters of WIDTH bytes. They are learned as products of a byte embedding and
weights, and applied as one table of 256 rows for each of the WIDTH places. Windows are pooled by their maximum over
overlapping chunks that cover the whole text: each has 2 * HALF windows and begins in the middle of the one before. A text
is the mean and the maximum of its chunks, and a dense layer of HIDDEN units makes of that one probability.

Learning: at most ``max_rows`` labelled documents outside the held-out fold, those of smallest hash, in SHARDS shards by
hash. In each round a task for each shard takes the network, learns from its own documents (Adam, batches in an order
fixed by a seed) and returns its parameters; the driver averages these few thousand numbers by the shards' sizes. Only
winning windows carry gradients. Of a text beyond TRAIN_BYTES bytes learning sees evenly spaced slices of that size in
all; scoring reads every byte of every row. No shuffle moves texts but the sample's.

Cases: a null text is empty, and a text below WIDTH bytes is filled up with zero bytes; a document with several labels is
of the least quality that one of them says; a labelled doc_id with several rows teaches one of its texts (that of smallest
hash); null labels are left out; without labelled rows, or with one kind only, every score is the smoothed share of good
ones; repeated rows are scored each; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlark.llm.common import bounded_batches, written
from planlark.llm.toxicity import held_out

WIDTH, FILTERS, EMBED, HALF, HIDDEN = 6, 24, 8, 128, 8
#: A round has at least STEPS batches a shard: a small sample is gone through several times.
SHARDS, ROUNDS, STEPS, BATCH, RATE, SLOWER, DECAY = 4, 10, 60, 16, 0.01, 0.85, 1e-4
TRAIN_BYTES, SLICE = 8192, 1024


@dataclass
class Network:
    embed: np.ndarray  # 256 x EMBED
    kernel: np.ndarray  # WIDTH x EMBED x FILTERS
    bias: np.ndarray  # FILTERS
    dense: np.ndarray  # 2 FILTERS x HIDDEN
    dense_bias: np.ndarray  # HIDDEN
    out: np.ndarray  # HIDDEN + 1

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.kernel, self.bias, self.dense, self.dense_bias, self.out]

    def tables(self) -> np.ndarray:
        """WIDTH x 256 x FILTERS: what a byte adds to each filter at each place."""
        return np.einsum("be,kef->kbf", self.embed, self.kernel).astype(np.float32)


def fresh(share: float, seed: int = 1) -> Network:
    rng = np.random.default_rng(seed)
    normal = lambda scale, *shape: rng.normal(0, scale, shape)
    out = normal(0.3, HIDDEN + 1)
    out[-1] = math.log(share / (1 - share))
    return Network(normal(0.5, 256, EMBED), normal(0.4, WIDTH, EMBED, FILTERS), np.zeros(FILTERS), normal(0.2, 2 * FILTERS, HIDDEN), np.zeros(HIDDEN), out)


def blocks(data: np.ndarray, tables: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The largest answer of each filter in each block of HALF windows, and at which window if asked for."""
    n = len(data) - WIDTH + 1
    count = -(-n // HALF)
    best = np.empty((count, FILTERS), np.float32)
    at = np.empty((count, FILTERS), np.int64) if where else None
    span = 32 * HALF
    for begin in range(0, n, span):
        end = min(n, begin + span)
        answers = tables[0][data[begin:end]]
        for k in range(1, WIDTH):
            answers += tables[k][data[begin + k : end + k]]
        first, whole = begin // HALF, (end - begin) // HALF
        view = answers[: whole * HALF].reshape(whole, HALF, FILTERS)
        if whole:
            best[first : first + whole] = view.max(axis=1)
            if where:
                at[first : first + whole] = view.argmax(axis=1) + (begin + HALF * np.arange(whole))[:, None]
        if whole * HALF < end - begin:
            rest = answers[whole * HALF :]
            best[first + whole] = rest.max(axis=0)
            if where:
                at[first + whole] = rest.argmax(axis=0) + begin + whole * HALF
    return best, at


def as_bytes(text: str) -> np.ndarray:
    raw = text.encode("utf-8", "replace")
    return np.frombuffer(raw + b"\0" * max(0, WIDTH - len(raw)), np.uint8)


def chunks(best: np.ndarray) -> np.ndarray:
    """Each chunk is two blocks; neighbours share one."""
    return best if len(best) == 1 else np.maximum(best[:-1], best[1:])


def top(net: Network, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """From chunks to the probability: (text vector, hidden, probability)."""
    live = np.maximum(pooled + net.bias, 0)
    v = np.concatenate([live.mean(axis=0), live.max(axis=0)])
    h = np.tanh(v @ net.dense + net.dense_bias)
    z = float(h @ net.out[:-1] + net.out[-1])
    return v, h, 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def probability(net: Network, tables: np.ndarray, text: str) -> float:
    return top(net, chunks(blocks(as_bytes(text), tables)[0]))[2]


def gradients(net: Network, tables: np.ndarray, docs: list[tuple[np.ndarray, int]]) -> list[np.ndarray]:
    grads = [np.zeros(p.shape) for p in net.parts()]
    g_tables = np.zeros(WIDTH * 256 * FILTERS)
    for data, y in docs:
        best, at = blocks(data, tables, where=True)
        if len(best) > 1:
            later = best[1:] > best[:-1]
            pooled, at = np.where(later, best[1:], best[:-1]), np.where(later, at[1:], at[:-1])
        else:
            pooled = best
        v, h, p = top(net, pooled)
        dz = p - y
        grads[5] += dz * np.r_[h, 1.0]
        dh = dz * net.out[:-1] * (1 - h * h)
        grads[3] += np.outer(v, dh)
        grads[4] += dh
        dv = net.dense @ dh
        live = pooled + net.bias
        dp = np.repeat(dv[None, :FILTERS] / len(pooled), len(pooled), axis=0)
        dp[live.argmax(axis=0), np.arange(FILTERS)] += dv[FILTERS:]
        dp *= live > 0
        grads[2] += dp.sum(axis=0)
        f = np.broadcast_to(np.arange(FILTERS), at.shape)
        for k in range(WIDTH):
            index = (k * 256 + data[at + k].astype(np.int64)) * FILTERS + f
            g_tables += np.bincount(index.ravel(), dp.ravel(), minlength=len(g_tables))
    g = g_tables.reshape(WIDTH, 256, FILTERS)
    grads[0] += np.einsum("kbf,kef->be", g, net.kernel)
    grads[1] += np.einsum("be,kbf->kef", net.embed, g)
    return [x / len(docs) + DECAY * p for x, p in zip(grads, net.parts(), strict=True)]


def for_learning(text: str) -> np.ndarray:
    """The bytes of a text; of one longer than TRAIN_BYTES, evenly spaced slices of that size in all."""
    data = as_bytes(text)
    if len(data) <= TRAIN_BYTES:
        return data
    starts = np.linspace(0, len(data) - SLICE, TRAIN_BYTES // SLICE).astype(int)
    return np.concatenate([data[s : s + SLICE] for s in starts])


def learn(net: Network, docs: list[tuple[np.ndarray, int]], rate: float, seed: int) -> Network:
    """Adam over the documents, once or until STEPS batches are done; the order is fixed by the seed."""
    parts = [p.copy() for p in net.parts()]
    one, two = [np.zeros(p.shape) for p in parts], [np.zeros(p.shape) for p in parts]
    rng = np.random.default_rng(seed)
    order = np.concatenate([rng.permutation(len(docs)) for _ in range(max(1, -(-STEPS * BATCH // len(docs))))])
    for step, begin in enumerate(range(0, len(order), BATCH), 1):
        now = Network(*parts)
        for i, g in enumerate(gradients(now, now.tables(), [docs[d] for d in order[begin : begin + BATCH]])):
            one[i] = 0.9 * one[i] + 0.1 * g
            two[i] = 0.99 * two[i] + 0.01 * g * g
            parts[i] = parts[i] - rate * (one[i] / (1 - 0.9**step)) / (np.sqrt(two[i] / (1 - 0.99**step)) + 1e-8)
    return Network(*parts)


def averaged(nets: list[tuple[Network, int]]) -> Network:
    total = sum(n for _, n in nets)
    return Network(*[sum(p * (n / total) for p, n in ps) for ps in zip(*([(p, n) for p in net.parts()] for net, n in nets), strict=True)])


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, data, quality, shard) of at most max_rows labelled documents outside the held-out fold, written once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = pa.array([for_learning(t or "").tobytes() for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "data": data, "quality": batch.column("quality")})

    bounded_batches(docs.sparkSession)
    ids = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out())
    ids = ids.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    once = texts.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("quality").alias("quality"))
    found = once.mapInArrow(cut, "doc_id long, data binary, quality int")
    return written(found.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(SHARDS)).cast("int")), "labelled_bytes")


def shard_task(net: Network, r: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Round r over one shard's documents: its parameters in one row."""

    def task(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        shard = int(rows["shard"].iloc[0])
        docs = [(np.frombuffer(d, np.uint8), int(q > 0)) for d, q in zip(rows["data"], rows["quality"], strict=True)]
        flat = np.concatenate([p.ravel() for p in learn(net, docs, RATE * SLOWER**r, SHARDS * r + shard).parts()])
        return pd.DataFrame({"shard": [shard], "n": [len(docs)], "flat": [flat]})

    return task


def fit(sample: DataFrame, rounds: int = ROUNDS) -> Network:
    """sample: (doc_id, data, quality, shard), bounded by its caller; each round learns in a task a shard."""
    counts = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("quality") > 0).cast("long")), F.lit(0)).alias("good")).first()
    net = fresh((counts.good + 1) / (counts.n + 2))
    if counts.good in (0, counts.n):
        net.out[:-1] = 0
        return net
    for r in range(rounds):
        found = sorted(sample.groupBy("shard").applyInPandas(shard_task(net, r), "shard int, n long, flat array<double>").collect())
        cuts = np.cumsum([p.size for p in net.parts()])[:-1]
        nets = [(Network(*[f.reshape(p.shape) for f, p in zip(np.split(np.array(row.flat), cuts), net.parts(), strict=True)]), row.n) for row in found]
        net = averaged(nets)
    return net


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score) of every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array([probability(net, tables, t or "") for t in batch.column("text").to_pylist()], pa.float64())})

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")


def op12_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = 6000) -> DataFrame:
    out = scored(docs, fit(labelled(docs, labels, max_rows)))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
