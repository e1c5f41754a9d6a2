"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal updates."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import need
from .workers import held as held_for

BITS = 18
#: Labelled rows that training takes at most: the first of a hash order. More would not move the
#: weights noticeably; scoring covers every document.
SAMPLE = 6000
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MASK = (1 << BITS) - 1
#: Tokens whose numbers a Python worker remembers; it starts afresh beyond that.
REMEMBERED = 60_000


def _number(token: str) -> tuple[int, int]:
    """(hash of the token, hash of its shape: letter case, digits or signs, and its length class)."""
    first = token[0]
    if first.isalpha() or first == "_":
        case = "U" if len(token) > 1 and token.isupper() else "T" if token[0].isupper() else "l"
        shape = case + ("1" if len(token) < 4 else "2" if len(token) < 9 else "3")
    elif first.isdigit():
        shape = "9"
    else:
        shape = token[:3]
    return zlib.crc32(token.lower().encode("utf-8", "surrogatepass")), zlib.crc32(shape.encode("utf-8", "surrogatepass"))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of the whole text's hashed 1-grams and 2-grams of words and of word shapes.

    A value is the n-gram's share of the text's tokens; so are the shares of repeated words and of line
    ends. Slot 0 is the bias, the only one of a text without tokens.
    """
    tokens = _TOKEN.findall(text or "")
    if not tokens:
        return np.zeros(1, np.int64), np.ones(1)
    known = held_for("quality")
    if len(known) > REMEMBERED:
        known.clear()
    for t in set(tokens).difference(known):
        known[t] = _number(t)
    both = np.array([known[t] for t in tokens], np.int64)
    word, shape = both[:, 0], both[:, 1]
    grams = [word, (shape * 40503 + 7) >> 3]
    if len(tokens) > 1:
        grams += [(word[:-1] * 31 + word[1:] * 1000003) >> 2, (shape[:-1] * 97 + shape[1:] * 613) >> 1]
    slots = np.concatenate(grams) & _MASK
    slots[slots < 8] += 8
    counts = np.bincount(slots, minlength=0) if len(slots) > 60000 else None
    if counts is None:
        slots, n = np.unique(slots, return_counts=True)
    else:
        slots = np.flatnonzero(counts)
        n = counts[slots]
    repeated = 1 - len(set(tokens)) / len(tokens)
    same = float((word[1:] == word[:-1]).mean()) if len(tokens) > 1 else 0.0
    extra = [1.0, repeated, same, min(len(tokens), 400) / 400, math.sqrt(same)]
    return np.concatenate((np.arange(5), slots)), np.concatenate((extra, n / len(tokens)))


class Ftrl:
    """Per-coordinate FTRL-proximal with L1 and L2 (McMahan et al., 2013)."""

    def __init__(self, alpha: float = 0.6, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, slots) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(slots)
        p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ values)))))
        g = (p - label) * values
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[slots] = n + g * g


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = 4) -> np.ndarray:
    """Weights learnt from at most ``sample`` labelled rows (``labels``: doc_id, label), in one bounded task.

    The sample is the first labels by a hash of doc_id; null labels, and labels without a document, are left
    out. A document counts once for each of its different labels, with the smallest of its texts where its
    doc_id is repeated. No rows: all weights zero.
    """
    known = need(labels, "doc_id", "label").where("label IS NOT NULL AND doc_id IS NOT NULL")
    taken = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    rows = need(docs, "doc_id", "text").join(F.broadcast(taken), "doc_id")
    # a doc_id with many rows, or very many labels, is no more than its share of the sample
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select(F.xxhash64("doc_id").alias("at"), "text", "label")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for batch in batches:
            for at, text, label in zip(*(batch.column(i).to_pylist() for i in range(3))):
                slots, values = features(text)
                seen.append((at, int(label == 1), slots.astype(np.int32), values.astype(np.float32)))
        seen.sort(key=lambda x: x[:2])
        model = Ftrl()
        for _ in range(epochs):
            for _, label, slots, values in seen:
                model.update(slots, values.astype(float), label)
        w = model.weights(slice(None))
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()], pa.binary())], ["w"])

    got = rows.repartition(1).mapInArrow(fit, "w binary").collect()
    return np.frombuffer(got[0]["w"], "<f4").astype(float) if got else np.zeros(1 << BITS)


def score(docs: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the probability of label 1: a sparse dot product per whole text.

    The broadcast weights have a fixed size (2**BITS floats). Null and empty texts get the score of the
    bias alone. A column of ``docs`` that has the name of the score already is replaced by it.
    """
    docs = docs.drop(name)
    columns, text = docs.columns, docs.columns.index("text")
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_for("quality")
        w = held.value.astype(float)
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 512):
                part = batch.slice(at, 512)
                dots = [float(w[s] @ v) for s, v in map(features, part.column(text).to_pylist())]
                p = 1 / (1 + np.exp(-np.clip(np.array(dots), -35, 35)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], [*columns, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
