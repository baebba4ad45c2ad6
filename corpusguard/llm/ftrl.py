"""Quality classifier: hashed n-grams, logistic loss, follow the regularised leader (operator 5).

A text is cut into runs of word characters and runs of symbols; unigrams and
bigrams of them, and a count of word trigrams that the text repeats, are hashed
into BUCKETS slots. One task trains on at most MOST labelled texts, chosen by
hash of doc_id (a documented bound: the model's size and training time do not
grow); scoring is a sparse dot product in one pass over all texts.

Defined results: a null or empty text has no n-grams and scores by the bias
alone; labels that are null, repeated or of unknown documents count once or not
at all; without labels every score is 0.5; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusguard.llm.common import _BASE, _LOWER, _TABLE, mix, powers, slices

BUCKETS = 1 << 18
MOST = 8000
EPOCHS, ALPHA, BETA, L1, L2 = 6, 5.0, 1.0, 0.005, 0.001
THRESHOLD = 0.3
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_REPEATS = BUCKETS
_BIAS = BUCKETS + 1


def features(data: np.ndarray, offs: np.ndarray):
    """(slots, values) of each row; values have length 1, and the bias has its own slot."""
    n = len(data)
    kind = _CLASS[data]
    first = kind > 0
    first[1:] &= kind[1:] != kind[:-1]
    at = offs[:-1][offs[:-1] < n]
    first[at] = kind[at] > 0
    starts = np.flatnonzero(first)
    toffs = np.searchsorted(starts, offs)
    h = starts.astype(np.uint64)
    if len(starts):
        p, q = powers(n)
        h = mix(np.add.reduceat(_TABLE[_LOWER[data]] * p * (kind > 0), starts) * q[starts])
    two = mix(h[:-1] * _BASE + h[1:]) if len(h) > 1 else h[:0]
    three = mix(two[:-1] * _BASE + h[2:]) if len(h) > 2 else h[:0]
    mask = np.uint64(BUCKETS - 1)
    for a, b in zip(toffs[:-1], toffs[1:], strict=True):
        slots, counts = np.unique(np.concatenate([h[a:b], two[a : max(a, b - 1)]]) & mask, return_counts=True)
        t = three[a : max(a, b - 2)]
        again = len(t) - len(np.unique(t))
        values = np.log1p(np.append(counts, again)).astype(np.float64)
        norm = np.sqrt(values @ values)
        yield np.append(slots.astype(np.int64), [_REPEATS, _BIAS]), np.append(values / norm if norm else values, 1.0)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """FTRL-proximal over the rows in order, EPOCHS times: the weights."""
    z, n = np.zeros(BUCKETS + 2), np.zeros(BUCKETS + 2)

    def weights(s):
        w = -(z[s] - np.sign(z[s]) * L1) / ((BETA + np.sqrt(n[s])) / ALPHA + L2)
        return np.where(np.abs(z[s]) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for s, x, y in rows:
            w = weights(s)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            root = np.sqrt(n[s])
            n[s] += g * g
            z[s] += g - (np.sqrt(n[s]) - root) / ALPHA * w
    return weights(np.arange(BUCKETS + 2))


def _learn(batches):
    rows = []
    for batch in batches:
        truth = batch.column("quality").to_pylist()
        for i, _, data, offs in slices(batch.column("text")):
            rows += [(s, x.astype(np.float32), truth[i + k]) for k, (s, x) in enumerate(features(data, offs))]
    yield pa.RecordBatch.from_arrays([pa.array([train(rows).astype(np.float32).tobytes()], pa.binary())], ["weights"])


def fit(docs: DataFrame, labels: DataFrame, held_out, most: int = MOST) -> np.ndarray:
    """Weights learned from labelled texts for which held_out (a Column of doc_id) is false."""
    truth = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).where(~held_out)
    picked = truth.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    one = texts.repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(1)), "doc_id", "text").select("text", "quality")
    learned = one.mapInArrow(_learn, "weights binary").first()
    return np.frombuffer(learned[0], np.float32) if learned else np.zeros(BUCKETS + 2, np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score: the probability of label 1 for every text."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = sent.value
        for batch in batches:
            for i, j, data, offs in slices(batch.column(1)):
                s = np.array([w[k] @ x for k, x in features(data, offs)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(1 / (1 + np.exp(-s)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op5_ftrl_classifier": op5}
ORACLE: dict[str, str] = {}
