"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are whether a text has a word (or a stem: a word's first letters), a pair of neighbouring words, or a pair with one or two words
between, hashed to 2**BITS coordinates. Each coordinate has its own rate, and L1 leaves few weights other than zero: they are broadcast as (index, weight) pairs and
scoring is one pass without a shuffle. The model is fit on a bounded, reproducible sample of labelled rows (``max_rows``, by a hash of the id).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import _common as C

BITS = 20
#: Lengths in bytes of the word beginnings that count as words too.
STEMS = (4, 5)
#: The bound of the labelled sample.
MAX_ROWS = 16_384
#: Words whose hashes a worker remembers, at most; others are hashed again.
CACHE_WORDS = 400_000
#: Everything in ASCII but letters and digits parts words.
_PARTS = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 17)
        if len(self) < CACHE_WORDS:
            self[word] = h
        return h


_HASHES = _Hashes()


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(document, coordinate) of every n-gram and skip-gram of whole texts, repeats included."""
    words: list[bytes] = []
    ends = []
    for text in texts:
        words += (text or "").lower().encode("utf-8", "surrogatepass").translate(_PARTS).split()
        ends.append(len(words))
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff([0, *ends]))
    shift, docs, coordinates = np.uint64(64 - BITS), [doc], [(h * _M[0]) >> np.uint64(64 - BITS)]
    for letters in STEMS:  # the beginnings of longer words stand for their inflected forms
        long = np.fromiter(map(len, words), np.int64, len(words)) > letters
        stems = np.fromiter(map(_HASHES.__getitem__, [w[:letters] + b"~" for w in words if len(w) > letters]), np.uint64, int(long.sum()))
        coordinates.append((stems * _M[3]) >> shift)
        docs.append(doc[long])
    for gap, m in ((1, _M[1]), (2, _M[2]), (3, _M[3])):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            pair = (h[:-gap] * m + h[gap:]) * _M[0]
            coordinates.append((pair ^ (pair << np.uint64(7)))[same] * _M[1] >> shift)
            docs.append(doc[gap:][same])
    return np.concatenate(docs), np.concatenate(coordinates).astype(np.int64)


class Ftrl:
    """FTRL-proximal for binary features."""

    def __init__(self, alpha: float = 0.2, beta: float = 1.0, l1: float = 5.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)  # the last is the intercept

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == 1 << BITS, 0.0, self.l1)  # the intercept isn't held to zero
        w = (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, float(w.sum()))))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _featurise(batches: Iterator[pa.RecordBatch], slice_rows: int = 256) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, slice_rows):
            batch = whole.slice(at, slice_rows)
            doc, coordinate = features(batch.column(2).to_pylist())
            keys = np.unique((doc << BITS) | coordinate)
            sizes = np.bincount(keys >> BITS, minlength=batch.num_rows)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array((keys & ((1 << BITS) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["rank", "label", "at"])


def _train(epochs: int, options: dict):
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("rank").to_numpy(), kind="stable")
        lists, labels, model = table.column("at").combine_chunks(), table.column("label").to_numpy(), Ftrl(**options)
        values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        for _ in range(epochs):
            for i in order.tolist():
                model.learn(np.append(values[ends[i] : ends[i + 1]], 1 << BITS), int(labels[i]))
        all_of = np.arange((1 << BITS) + 1)
        w = model.weights(all_of)
        kept = np.flatnonzero(w)
        return pa.table({"coordinate": pa.array(all_of[kept].astype(np.int32)), "weight": pa.array(w[kept])})

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, epochs: int = 3, seed: int = 11, **options: float) -> list[tuple[int, float]]:
    """The non-zero (coordinate, weight) pairs; at most 2**BITS + 1, far fewer by L1.

    Rows without a label or id don't count; an id labelled more than once is positive if any of its labels is. With no labelled rows
    there are no weights and every score is one half.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna().groupBy("id").agg(F.max("label").alias("label"))
    there = marked.join(docs.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    n = there.count()
    ranked = there.withColumn("rank", F.xxhash64("id", F.lit(seed)))
    if n > 2 * max_rows:  # ranks are uniform: rows that can't be among the first needn't be sorted
        ranked = ranked.filter(F.col("rank") < int((2 * max_rows / n * 2 - 1) * 2**63))
    sample = ranked.orderBy("rank", "id").limit(max_rows)  # the bound of the sample
    sample = C.materialize(sample, "sample")
    texts = docs.select(F.col(id_col).alias("id"), C.text_of(text_col).alias("text")).join(F.broadcast(sample), "id")
    rows = texts.select("rank", "label", "text").mapInArrow(_featurise, "rank bigint, label int, at array<int>")
    fitted = rows.withColumn("model", F.lit(0)).groupBy("model").applyInArrow(_train(epochs, options), "coordinate int, weight double")
    return [(r.coordinate, r.weight) for r in fitted.collect()]


def _score(weights_of, slice_rows: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros((1 << BITS) + 1)
        for k, v in weights_of.value:
            w[k] = v
        for whole in batches:
            for at in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(at, slice_rows)
                doc, coordinate = features(batch.column(1).to_pylist())
                there = w[coordinate] != 0.0
                keys = np.unique((doc[there] << BITS) | coordinate[there])
                total = w[-1] + np.bincount(keys >> BITS, weights=w[keys & ((1 << BITS) - 1)], minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -700.0, 700.0))))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, weights: list[tuple[int, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) of every whole text; null and empty texts get the intercept alone."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), C.text_of(text_col).alias("text"))
    return rows.mapInArrow(_score(sent), "doc_id bigint, score double")
