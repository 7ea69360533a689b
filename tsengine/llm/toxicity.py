"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are present or absent: a word, its stem (the first five letters, so that endings share what is learned), two
words in a row, and two words with one between them, lower-cased, bare of punctuation, hashed into ``2**bits`` places.
Training takes a bounded sample of the labelled rows, by a hash of their id (at most ``TRAINING_ROWS``, and no more of
them than ``TRAINING_BYTES`` of packed features), and walks it row by row: every coordinate has its own rate, and the L1
bound leaves most weights at exactly zero, so the model that is sent to the executors is a few places and weights. The
bias starts at the sample's share of toxic rows, with ``PRIOR`` of ``PRIOR_ROWS`` rows seen before.

Defined results: null and empty texts score as the bias alone; null labels and null ids are not learned from; with no
labelled rows every score is ``PRIOR``, under the threshold, so nothing is predicted toxic; with labels of one kind only
it stays at that kind's side; repeated rows score alike; whole texts are read. Only the named columns are read.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tsengine.llm.common import chunks, fold_column, materialise, new_name, once_per_worker, table, utf8

BITS, THRESHOLD, STEM = 20, 0.3, 5
#: At most so many labelled rows are learned from; they are chosen by a hash of their id.
TRAINING_ROWS = 12_000
#: The driver holds at most so many bytes of packed features, and one row more.
TRAINING_BYTES = 96_000_000
#: What is believed of the share of toxic rows before any label is seen.
PRIOR, PRIOR_ROWS = 0.05, 20
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
REMEMBERED = 300_000
#: Odd multipliers that tell the kinds of features apart.
NEXT, SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Model(NamedTuple):
    """Places and weights that are not zero, the bias, and the number of bits that places are hashed into."""

    places: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int


class WordHash(dict):
    """Lower-case word -> its hash; stem: the same of its first letters."""

    def __init__(self, stem: bool = False):
        super().__init__()
        self.stem = None if stem else WordHash(True)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        bare = word.strip(PUNCTUATION)
        found = xxhash.xxh3_64_intdigest(bare if self.stem is not None else b"\0" + bare.decode("utf-8", "replace")[:STEM].encode())
        if len(word) <= 64:
            self[word] = found
        return found


def features(text: bytes, words: WordHash, bits: int = BITS) -> np.ndarray:
    """The places of a text's features, with repeats."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.int64)
    h, stems = (np.fromiter(map(of.__getitem__, tokens), np.uint64, len(tokens)) for of in (words, words.stem))
    every = np.concatenate([h, stems, h[:-1] * NEXT + h[1:], h[:-2] * SKIP + h[2:]])
    return ((every * NEXT) >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """FTRL-proximal with per-coordinate rates."""

    def __init__(self, bits: int = BITS, bias: float = 0.0, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.alpha, self.beta, self.l1, self.l2, self.bias, self.bias_n = alpha, beta, l1, l2, bias, 0.0

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        gradient = sigmoid(w.sum() + self.bias) - label
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + gradient**2) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + gradient**2
        self.bias_n += gradient**2
        self.bias -= self.alpha / (self.beta + np.sqrt(self.bias_n)) * gradient


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most_rows: int = TRAINING_ROWS, epochs: int = 4, bits: int = BITS, most_bytes: int = TRAINING_BYTES) -> Model:
    """A model from the documents whose id has a label of 0 or 1, at most most_rows ids, and the first of them that fill most_bytes.

    An id with several labels counts as the larger, one with several texts learns from one of them.
    """
    marks = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("label"))
    order = F.xxhash64(F.col("id").cast("string"))
    ids = docs.select(F.col(key).alias("id")).distinct().join(marks, "id").orderBy(order, "id").limit(most_rows)

    def run(batches):
        words = once_per_worker("toxic words", WordHash)
        for whole in batches:
            for batch in chunks(whole, "text"):
                found = [zlib.compress(np.unique(features(t, words, bits)).astype("<u4").tobytes(), 1) for t in utf8(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("label"), pa.array(found, pa.binary())], ["order", "label", "features"])

    # Only ids are moved to choose the sample; what is broadcast are the chosen ids, at most most_rows.
    chosen = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(ids), "id").select(order.alias("order"), "label", "text")
    rows = materialise(chosen.mapInArrow(run, "order long, label int, features binary").groupBy("order", "label").agg(F.min("features").alias("features")), "sample")
    # At most most_rows lengths are sent first; then the rows that fit, in the order of the walk.
    lengths = sorted(tuple(r) for r in rows.select("order", "label", F.length("features")).collect())
    sums = list(accumulate(n for *_, n in lengths))
    some = F.lit(True)
    if sums and sums[-1] > most_bytes:
        last = lengths[bisect_right(sums, most_bytes)]
        some = F.struct("order", "label") <= F.struct(F.lit(last[0]), F.lit(last[1]))
    sample = sorted((r.order, r.label, bytes(r.features)) for r in rows.filter(some).collect())
    share = (sum(y for _, y, _ in sample) + PRIOR * PRIOR_ROWS) / (len(sample) + PRIOR_ROWS)
    model = Ftrl(bits, math.log(share / (1 - share)))
    for _ in range(epochs if sample else 0):
        for _, y, held in sample:  # kept compressed: a few KB a row
            model.learn(np.frombuffer(zlib.decompress(held), "<u4"), y)
    weights = model.weights(slice(None))
    places = np.flatnonzero(weights)
    return Model(places, weights[places], model.bias, bits)


def score(df: DataFrame, text: str, model: Model, name: str = "score") -> DataFrame:
    """The input with a score column from 0 to 1. An existing column of that name is replaced."""
    # At most 2**bits places, whatever the data; L1 leaves a small part of them.
    sent, held, bits = df.sparkSession.sparkContext.broadcast(model), new_name("toxic weights"), model.bits
    df = df.drop(name)
    columns = df.columns

    def dense():
        out = np.zeros(1 << bits, np.float32)
        out[sent.value.places] = sent.value.weights
        return out

    def run(batches):
        words, table_ = once_per_worker("toxic words", WordHash), once_per_worker(held, dense)
        for whole in batches:
            for batch in chunks(whole, text):
                scores = []
                for t in utf8(batch.column(text)):
                    at = features(t, words, bits)
                    scores.append(float(sigmoid(table_[np.unique(at[table_[at] != 0])].sum(dtype=np.float64) + sent.value.bias)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*columns, name])

    return df.mapInArrow(run, StructType([*df.schema.fields]).add(name, DoubleType()))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = fold_column(F.col("doc_id"), 4)
    model = train(docs.filter(remainder != 2), table(spark, sf_dir, "labels"))
    scored = score(docs, "text", model)
    return scored.select("doc_id", (remainder == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
