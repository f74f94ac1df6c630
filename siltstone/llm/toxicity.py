"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 20
MAX_TRAIN_ROWS = 20_000  # labelled rows that the model is fitted on
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.1

#: Odd 64-bit multipliers that mix the hashes of a word (one) and of words at a distance of one and two.
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Sorted distinct slots of a text's words, word pairs, and pairs that skip a word. Slot 0 is the bias, in every text."""
    words = common.alnum_words(text)
    h = np.array([zlib.crc32(w) for w in words], np.uint64)
    shift = np.uint64(64 - bits)
    one, a, b, c, d = (np.uint64(m) for m in _MIX)
    with np.errstate(over="ignore"):
        mixed = [(h + one) * one, (h[:-1] * a) ^ (h[1:] * b) * one, (h[:-2] * c) ^ (h[2:] * d) * one]
        slots = np.concatenate([((x ^ x >> np.uint64(29)) * b >> shift) for x in mixed])
    return np.unique(np.concatenate([[0], slots]).astype(np.uint32))


class FTRL:
    """Per-coordinate rates and L1 sparsity; features are present or absent."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, slots) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        l1 = np.where(np.asarray(slots) == 0, 0.0, self.l1) if not isinstance(slots, slice) else self.l1
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, slots: np.ndarray, label: int) -> None:
        w = self.weights(slots)
        g = _sigmoid(w.sum()) - label
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[slots] += g * g

    def model(self) -> tuple[np.ndarray, np.ndarray]:
        """Slots and weights that are not zero."""
        w = self.weights(np.arange(len(self.z)))
        slots = np.flatnonzero(w)
        return slots.astype(np.int32), w[slots].astype(np.float32)


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, float(x)))))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, bits: int = BITS, max_rows: int = MAX_TRAIN_ROWS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights, one for each slot, from at most ``max_rows`` labelled rows out of all folds but 0, chosen by a hash of their id.

    The sample's ids are few enough to broadcast by that bound; features are made where the texts are, and one task learns from
    them in the order of the hash, so that the model is the same however the input is split. Labels of equal id count as one (the
    largest); repeated rows are learnt from once, and rows of one id with different texts each, within the same bound. Null ids and
    labels are left out. No labelled rows, or an empty table: all weights are 0 and the bias is very low, so every score is near 0.
    """
    given = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).dropna()
    sample = given.filter(common.fold("id", folds) != 0).groupBy("id").agg(F.max("y").alias("y")).withColumn("order", F.xxhash64("id")).orderBy("order", "id").limit(max_rows)
    labelled = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    chosen = labelled.select("order", "id", "text_key").distinct().orderBy("order", "id", "text_key").limit(max_rows)  # an id may be that of many rows
    rows = labelled.join(F.broadcast(chosen), ["order", "id", "text_key"]).groupBy("order", "id", "text_key").agg(F.first("y").alias("y"), F.first("text").alias("text"))

    def extract(batches):
        for batch in batches:
            c = {f.name: batch.column(k) for k, f in enumerate(batch.schema)}
            slots = [features(t, bits).tobytes() for t in c["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([c["order"], c["id"], c["y"], pa.array(slots, pa.binary())], names=["order", "id", "y", "slots"])

    def learn(batches):
        model, rows = FTRL(bits), []
        for batch in batches:
            rows += zip(batch.column(2).to_pylist(), (np.frombuffer(x, np.uint32) for x in batch.column(3).to_pylist()))
        for _ in range(epochs):
            for y, slots in rows:
                model.learn(slots, y)
        slots, weights = model.model() if rows else (np.array([0], np.int32), np.array([-35.0], np.float32))
        yield pa.RecordBatch.from_arrays([pa.array([slots.tobytes()], pa.binary()), pa.array([weights.tobytes()], pa.binary())], names=["slots", "weights"])

    made = rows.mapInArrow(extract, "order long, id long, y int, slots binary").repartition(1).sortWithinPartitions("order", "id", "slots")
    dense = np.zeros(1 << bits, np.float32)
    out = made.mapInArrow(learn, "slots binary, weights binary").collect()
    if not out:
        dense[0] = -35.0
    for row in out:
        dense[np.frombuffer(row["slots"], np.int32)] = np.frombuffer(row["weights"], np.float32)
    return dense


def score(docs: DataFrame, weights: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, bits: int = BITS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row, in no shuffle.

    Null and empty texts get the bias alone. Repeated rows all return, with equal scores. Very long texts are read whole. Other columns
    are not read. An empty table gives no rows.
    """
    slots = np.flatnonzero(weights).astype(np.int32)
    sent = docs.sparkSession.sparkContext.broadcast((slots, weights[slots]))  # at most 2**bits of each

    def apply(batches):
        dense = np.zeros(1 << bits)
        dense[sent.value[0]] = sent.value[1]
        for batch in batches:
            scores = [_sigmoid(dense[features(t, bits)].sum()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), (common.fold(id_col, folds) == 0).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(apply, f"doc_id {kind}, held_out boolean, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: fit on the labelled rows outside fold 0, score every document."""
    docs = common.documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
