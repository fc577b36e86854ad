"""Quality classifier of supervised subword embeddings.

A text's features are its words and the character n-grams inside words (an n-gram
may begin or end with the blank beside a word), each hashed to a bucket with a
learned vector. A text is the mean of its features' vectors; a linear layer with
softmax gives the class probabilities. Vectors and layer are trained by stochastic
gradient descent in numpy: in each epoch every shard of the training rows descends on
its own from the shared weights, and the shards' weights are averaged.

Training reads at most ``max_train_docs`` labelled rows, by digest of their id, and
their whole texts; scoring reads whole texts of all rows. A null or empty text has no
features and scores by the layer's bias. Without labelled rows every score is 0.5.
Rows without a label teach nothing; repeated rows are scored alike. A score of exactly 0.5
predicts label 1. Very long texts are read whole. An empty table gives an empty result; an empty
table of labels counts as one without labels. Extra columns are ignored, whatever their names: the
result has the id and the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.llm import common as c
from sparkprep.llm.language_id import held_out

#: Odd multipliers of the positions in a character n-gram.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def features(raw: np.ndarray, at: np.ndarray, buckets: int, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every feature of a slice of texts; words use the lower half of the buckets, n-grams the upper."""
    half = np.uint64(buckets // 2)
    digests, rows = c.word_digests(raw, at)
    found = [(digests % half).astype(np.int64)]
    owner = [np.repeat(np.arange(len(at) - 1), np.diff(rows))]
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at]
    row_of = np.repeat(np.arange(len(at) - 1), np.diff(begins))
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    points = np.where(blank, np.uint64(32), points)
    for n in sizes:
        m = len(points) - n + 1
        if m <= 0:
            continue
        inside = row_of[:m] == row_of[n - 1 :]
        for k in range(1, n - 1):
            inside &= ~blank[k : m + k]
        code = np.full(m, n, dtype=np.uint64)
        for k in range(n):
            code += points[k : m + k] * _PLACES[k]
        found.append((half + c.mix(code[inside]) % half).astype(np.int64))
        owner.append(row_of[:m][inside])
    return np.concatenate(found), np.concatenate(owner)


class SubwordModel:
    """buckets x dim vectors, and a 2 x (dim + 1) layer."""

    def __init__(self, vectors: np.ndarray, layer: np.ndarray, sizes: tuple[int, ...]) -> None:
        self.vectors, self.layer, self.sizes = vectors, layer, sizes

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability of class 1. The layer is linear, so each bucket's share of the log odds is worked out once."""
        step = self.layer[1] - self.layer[0]
        odds = (self.vectors @ step[:-1]).astype(np.float64)
        out = []
        for first, last, raw, at in c.text_slices(texts):
            bucket, row = features(raw, at, len(odds), self.sizes)
            sums = np.bincount(row, weights=odds[bucket], minlength=last - first)
            out.append(sums / np.maximum(1, np.bincount(row, minlength=last - first)) + step[-1])
        return 1 / (1 + np.exp(-np.concatenate(out))) if out else np.zeros(0)


def _featurise(buckets: int, sizes: tuple[int, ...]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).to_pylist()
            keys, counts = [], []
            for first, last, raw, at in c.text_slices(batch.column(0)):
                bucket, row = features(raw, at, buckets, sizes)
                both, n = np.unique(row * buckets + bucket, return_counts=True)
                cuts = np.searchsorted(both, np.arange(last - first + 1) * buckets)
                for i in range(last - first):
                    keys.append((both[cuts[i] : cuts[i + 1]] % buckets).astype(np.int32))
                    counts.append(n[cuts[i] : cuts[i + 1]].astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(keys, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))], ["label", "buckets", "counts"])

    return run


def _descend(shared, rate: float, epoch: int, passes: int):  # noqa: ANN001, ANN202
    """Passes over a shard's rows; gives the shard's weights."""

    def run(shard: pa.Table) -> pa.Table:
        vectors, layer = (x.copy() for x in shared.value)
        rows = [(label, np.array(b, dtype=np.int64), np.array(n, dtype=np.float32)) for label, b, n in zip(*(shard.column(x).to_numpy() for x in ("label", "buckets", "counts")), strict=True)]
        state = np.random.RandomState(epoch)
        for i in np.concatenate([state.permutation(len(rows)) for _ in range(passes)]).tolist():
            label, bucket, n = rows[i]
            share = n / max(1.0, float(n.sum()))
            mean = np.append(share @ vectors[bucket], 1.0).astype(np.float32) if len(bucket) else np.append(np.zeros(vectors.shape[1]), 1.0).astype(np.float32)
            out = layer @ mean
            p = np.exp(out - out.max())
            p /= p.sum()
            p[label] -= 1.0
            back = p @ layer[:, :-1]
            layer -= rate * np.outer(p, mean).astype(np.float32)
            if len(bucket):
                vectors[bucket] -= rate * share[:, None] * back[None, :]
        return pa.table({"n": pa.array([len(rows)], pa.int64()), "vectors": pa.array([vectors.astype(np.float32).tobytes()], pa.binary()), "layer": pa.array([layer.astype(np.float32).tobytes()], pa.binary())})

    return run


def fit_quality_model(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_train_docs: int = 6000,
    buckets: int = 1 << 16,
    dim: int = 8,
    sizes: tuple[int, ...] = (3, 4),
    epochs: int = 6,
    visits: int = 36_000,
    rate: float = 2.0,
    shards: int = 4,
) -> SubwordModel:
    known = labels.where(F.col(label_col).isin(0, 1)) if usable is None else labels.where(F.col(label_col).isin(0, 1) & usable)
    sample = known.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).orderBy(F.xxhash64("_id"), "_id", "_label").limit(max_train_docs)
    # at most max_train_docs rows of 12 bytes are broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), F.col("id") == F.col("_id")).select("text", F.col("_label").alias("label"), "_id")
    made = rows.select("text", "label").mapInArrow(_featurise(buckets, sizes), "label int, buckets array<int>, counts array<float>")
    # shards are groups, so there are as many weights as shards however many partitions hold them
    made = c.durable(made.withColumn("shard", F.pmod(F.xxhash64("buckets", "counts"), F.lit(shards))))
    # few rows are passed over more often, so that about `visits` steps are made in all
    passes = min(20, max(1, round(visits / epochs / max(1, made.count()))))
    state = np.random.RandomState(11)
    vectors = state.uniform(-1.0 / dim, 1.0 / dim, (buckets, dim)).astype(np.float32)
    layer = np.zeros((2, dim + 1), dtype=np.float32)
    context = docs.sparkSession.sparkContext
    for epoch in range(epochs):
        shared = context.broadcast((vectors, layer))
        parts = made.groupBy("shard").applyInArrow(_descend(shared, rate * (1 - epoch / epochs), epoch, passes), "n long, vectors binary, layer binary").collect()  # a row a shard, of the model's size
        if not parts:
            break
        weight = np.array([p["n"] for p in parts], dtype=np.float64) / sum(p["n"] for p in parts)
        vectors = sum(w * np.frombuffer(p["vectors"], dtype=np.float32).reshape(buckets, dim) for w, p in zip(weight, parts, strict=True)).astype(np.float32)
        layer = sum(w * np.frombuffer(p["layer"], dtype=np.float32).reshape(2, dim + 1) for w, p in zip(weight, parts, strict=True)).astype(np.float32)
    return SubwordModel(vectors, layer, sizes)


def score_quality(docs: DataFrame, model: SubwordModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1)), pa.float64())], [id_col, "score"])

    rows = docs.select(F.col(id_col), F.col(text_col))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, score double")


def op5_quality_model(spark, sf_dir: str) -> DataFrame:
    docs, labels = c.read(spark, sf_dir, "documents").select("doc_id", "text"), c.read(spark, sf_dir, "labels")
    model = fit_quality_model(docs, labels, usable=~held_out(1, 3))
    out = score_quality(docs, model)
    return out.select("doc_id", held_out(1, 3).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
