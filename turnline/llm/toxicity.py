"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, its pairs of neighbours
and its pairs with one word between (``A-Z`` lower-cased, words between ASCII
white space, ASCII punctuation stripped).  One pass of FTRL-proximal with
per-coordinate rates and L1 over a bounded sample of labelled rows gives weights
of which nearly all are zero; the rest is broadcast, at most ``2**bits`` numbers.

The sample is the ``train_rows`` rows of least hash of their id, read in that
order in one task: that bound is the only one.  Scoring covers every whole text.
Null texts count as empty and get the score of the bias alone.  Rows without a
label and null labels teach nothing; of several labels of a document the largest
counts.  Without any label every score is one half; repeated rows get equal scores,
and an empty table gives no rows.  A very long text is a slice of its own, read whole.
Kept columns may have any names but that of the score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnline.llm.common import arrow_map, as_bytes, hashed, slices, words_of

#: Feature space, and rows that the classifier is fitted on at most.
BITS, TRAIN_ROWS = 20, 20_000
#: Learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.1

#: Bytes of text whose features a worker holds at a time.
FEATURE_BYTES = 3 << 20

TOXIC_FROM = 0.3
PUNCTUATION = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)


def fold(id_column: Column, parts: int) -> Column:
    """CRC-32 of the id as text, modulo ``parts``; a null id is in part 0."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % parts, F.lit(0))


def feature_rows(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row number and feature of every word, pair and skip pair; features repeat."""
    distinct, number, bounds = words_of(pa.array([t.translate(PUNCTUATION) for t in texts], pa.binary()))
    h = hashed(distinct, zlib.crc32)[number]
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    rows, features = [row], [h * np.uint64(0x9E3779B97F4A7C15)]
    for gap, factor in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        same = row[gap:] == row[:-gap]
        pair = h[:-gap] * np.uint64(factor) + h[gap:] * np.uint64(0x27D4EB2F165667C5) + np.uint64(gap)
        rows.append(row[gap:][same])
        features.append((pair * np.uint64(0x9E3779B97F4A7C15))[same])
    return np.concatenate(rows), (np.concatenate(features) >> np.uint64(64 - bits)).astype(np.int64)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Ftrl:
    """One pass over rows of distinct feature numbers; the bias is the coordinate after the last feature."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, features: np.ndarray, label: int) -> None:
        at = np.append(features, len(self.z) - 1)
        w = self.weights(at)
        g = float(sigmoid(w.sum())) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(
    docs: DataFrame, labels: DataFrame, label_column: str = "toxic", train_rows: int = TRAIN_ROWS, bits: int = BITS,
    id_column: str = "doc_id", text_column: str = "text",
) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of the weights that are not zero; the last number, ``2**bits``, is the bias."""
    order = F.xxhash64(F.col(id_column).cast("string"))
    sample = (
        labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
        .groupBy(id_column).agg(F.max(label_column).cast("int").alias("label_"))
        .withColumn("order_", order).orderBy("order_", id_column).limit(train_rows)
    )
    known = docs.select(id_column, as_bytes(text_column).alias("text_")).join(F.broadcast(sample), id_column)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text_", FEATURE_BYTES):
            row, feature = feature_rows(part.column("text_").to_pylist(), bits)
            distinct = np.unique(row << bits | feature)
            bounds = np.searchsorted(distinct, np.arange(part.num_rows + 1) << bits)
            found = (distinct & ((1 << bits) - 1)).astype("<i4")
            yield pa.RecordBatch.from_arrays(
                [part.column("order_"), part.column("label_"),
                 pa.array([found[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())],
                names=["order_", "label_", "features"],
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl(1 << bits)
        for batch in batches:
            for label, features in zip(batch.column("label_").to_pylist(), batch.column("features").to_pylist()):
                model.learn(np.frombuffer(features, "<i4"), label)
        weights = model.weights(slice(None))
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(weights[at])], names=["at", "weight"])

    rows = arrow_map(known.select("order_", "label_", "text_"), extract, T.StructType([
        T.StructField("order_", T.LongType()), T.StructField("label_", T.IntegerType()),
        T.StructField("features", T.BinaryType()),
    ]))
    model = rows.repartition(1).sortWithinPartitions("order_", "features").mapInArrow(learn, "at long, weight double")
    found = sorted(map(tuple, model.collect()))
    return np.array([a for a, _ in found], np.int64), np.array([w for _, w in found], np.float64)


def score(
    docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], kept: list[str], bits: int = BITS,
    text_column: str = "text", score_column: str = "score",
) -> DataFrame:
    """The kept columns as they are, and the score of the text in a column of the given name.

    Each text crosses to Python once: as the kept column, if it is one of them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # at most 2**bits + 1 numbers
    place = kept.index(text_column) if text_column in kept else len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values = shared.value
        dense = np.zeros((1 << bits) + 1)
        dense[at] = values
        for part in slices(batches, place, FEATURE_BYTES):
            texts = pc.fill_null(part.column(place).cast(pa.binary()), b"")
            row, feature = feature_rows(texts.to_pylist(), bits)
            used = dense[feature] != 0
            distinct = np.unique(row[used] << bits | feature[used])
            z = np.bincount(distinct >> bits, dense[distinct & ((1 << bits) - 1)], part.num_rows) + dense[-1]
            columns = [part.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sigmoid(z))], names=[*kept, score_column])

    source = docs.select(*kept) if place < len(kept) else docs.select(*kept, text_column)
    return arrow_map(source, run, T.StructType([*docs.select(*kept).schema.fields, T.StructField(score_column, T.DoubleType())]))
