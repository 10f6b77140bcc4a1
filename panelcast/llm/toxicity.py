"""Toxicity scores from a linear classifier over character n-grams.

Each n-gram found in a text is a feature whose value is its naive Bayes log-count ratio; a logistic
regression on these values gives the probability of the label. Counting and feature extraction run in
tasks; what reaches the driver is bounded by the number of hash buckets and of training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import give_back, held_out, rows_of

BITS = 20
SIZES = (4, 5)
"""Lengths of the n-grams, in bytes of the lower-cased text between two spaces."""
FIT_ROWS = 10_000
"""Labelled rows the model is fitted on, about: a bound of the training sample."""
LEAST_RATIO = 1.0
"""Features whose log-count ratio is nearer to 0 tell too little and get no weight."""
LEAST_DOCS = 3
LEAST_DEVIATION = 5.0
"""Standard deviations by which a feature's count among label 1 must differ from chance."""
BLOCK = 1 << 14
CHUNK = 100


def gram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every n-gram occurrence."""
    raw = [(" " + t.lower() + " ").encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64)
    doc = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
    buckets, owners = [], []
    h = np.zeros(len(data), dtype=np.uint64)
    for n in range(1, max(SIZES) + 1):
        h = h[:len(data) - n + 1] * np.uint64(257) + data[n - 1:]
        if n in SIZES and len(h):
            mixed = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            inside = doc[:len(h)] == doc[n - 1:]
            buckets.append((mixed >> np.uint64(64 - BITS)).astype(np.int32)[inside])
            owners.append(doc[:len(h)][inside])
    if not buckets:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
    return np.concatenate(buckets), np.concatenate(owners)


def _distinct(buckets: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(owners.astype(np.int64) << BITS | buckets)
    return (pairs & ((1 << BITS) - 1)).astype(np.int32), (pairs >> BITS).astype(np.int32)


@dataclass
class Model:
    """Weight of each bucket (ratio times regression weight) and the intercept."""

    weights: np.ndarray
    bias: float


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text`` and ``y`` of about ``rows`` labelled documents that are not held out, chosen by a hash of
    the id. A document with several labels counts as 1 if any is 1; null labels and ids are left out."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(
        F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(
        "doc_id").agg((F.max("y") > 0).cast("int").alias("y"))
    share = min(1.0, rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # The draw has about ``rows`` rows of two numbers: small at any size of the tables.
    return rows_of(docs, id_col, text_col).join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "y")


def fit(train: DataFrame, steps: int = 100, rate: float = 0.03, decay: float = 1e-3) -> Model:
    """Model from ``text`` and ``y`` (0 or 1). Without rows of both labels every text gets the smoothed
    share of label 1."""
    spark = train.sparkSession
    counts = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    bias = float(np.log((n1 + 1) / (n0 + 1)))
    weights = np.zeros(1 << BITS, dtype=np.float32)
    if not n1 or not n0:
        return Model(weights, bias)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, 1 << BITS), dtype=np.int32)
        for batch in batches:
            texts, y = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist())
            for at in range(0, len(texts), CHUNK):
                b, d = _distinct(*gram_buckets(texts[at:at + CHUNK]))
                for k in (0, 1):
                    sums[k] += np.bincount(b[y[at:at + CHUNK][d] == k], minlength=1 << BITS).astype(np.int32)
        parts = range(0, 1 << BITS, BLOCK)
        yield pa.RecordBatch.from_pydict({
            "block": pa.array([p // BLOCK for p in parts], pa.int32()),
            "zero": [sums[0, p:p + BLOCK].tobytes() for p in parts],
            "one": [sums[1, p:p + BLOCK].tobytes() for p in parts]})

    def ratios(frame: pd.DataFrame) -> pd.DataFrame:
        zero, one = (np.sum([np.frombuffer(v, dtype=np.int32) for v in frame[c]], axis=0) for c in ("zero", "one"))
        r = np.log((one + 1) / (n1 + 2)) - np.log((zero + 1) / (n0 + 2))
        seen, part = one + zero, n1 / (n1 + n0)
        off = np.abs(one - seen * part) / np.sqrt(np.maximum(seen, 1) * part * (1 - part))
        told = np.flatnonzero((seen >= LEAST_DOCS) & (np.abs(r) >= LEAST_RATIO) & (off >= LEAST_DEVIATION))
        return pd.DataFrame({"bucket": told + frame["block"].iloc[0] * BLOCK, "ratio": r[told]})

    found = train.select("text", "y").mapInArrow(count, "block int, zero binary, one binary").groupBy(
        "block").applyInPandas(ratios, "bucket long, ratio double").toPandas()
    ratio = np.zeros(1 << BITS)
    ratio[found["bucket"].to_numpy()] = found["ratio"].to_numpy()
    shared = spark.sparkContext.broadcast(ratio != 0)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(0).to_pylist(), []
            for at in range(0, len(texts), CHUNK):
                b, d = gram_buckets(texts[at:at + CHUNK])
                told = shared.value[b]
                b, d = _distinct(b[told], d[told])
                ends = np.searchsorted(d, np.arange(len(texts[at:at + CHUNK]) + 1))
                out += [b[i:j].tobytes() for i, j in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1)], ["f", "y"])

    rows = train.select("text", "y").mapInArrow(features, "f binary, y int").toPandas()
    y = rows["y"].to_numpy().astype(np.float64)
    parts = [np.frombuffer(f, dtype=np.int32) for f in rows["f"]]
    owner = np.repeat(np.arange(len(y)), [len(p) for p in parts])
    bucket = np.concatenate(parts)
    value = ratio[bucket]
    w, m, v = (np.zeros(1 << BITS) for _ in range(3))
    for step in range(1, steps + 1):  # full-batch gradient with adaptive steps
        z = np.bincount(owner, weights=w[bucket] * value, minlength=len(y)) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - y
        grad = np.bincount(bucket, weights=error[owner] * value, minlength=1 << BITS) / len(y) + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        bias -= 0.1 * error.mean()
    return Model((w * ratio).astype(np.float32), float(bias))


def scores(texts: list[str], model: Model) -> np.ndarray:
    """Probability of label 1 for each text."""
    out = np.zeros(len(texts))
    for at in range(0, len(texts), CHUNK):
        part = texts[at:at + CHUNK]
        b, d = gram_buckets(part)
        told = np.flatnonzero(model.weights[b])
        b, d = _distinct(b[told], d[told])
        z = np.bincount(d, weights=model.weights[b], minlength=len(part)) + model.bias
        out[at:at + CHUNK] = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    return out


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and ``predicted`` of every row, from the whole text. Null and empty
    texts get the score of a text without features; repeated rows are scored alike."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores(batch.column(1).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found), pa.array((found >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"])
            give_back()

    return rows_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, unchanged and without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.string()).fill_null("").to_pylist()
            yield batch.filter(pa.array(scores(texts, sent.value) < threshold))
            del texts
            give_back()

    return docs.mapInArrow(keep, docs.schema)
