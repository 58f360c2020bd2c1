"""Vector code compression by ball k-means: a byte per part of a vector, with exact assignments.

Components become whole numbers, ``floor(scale * x)``; a vector is cut into equal consecutive parts, and each part
position has a codebook of its own.  A round assigns every part to its nearest entry (squared Euclidean distance, ties
to the lower index) and moves each entry to the floor of the mean of its parts; entries without parts stay.

The first assignment looks at all entries.  From then on an entry and its parts are a ball: its radius is the one
around the entry before it moved plus the way it moved.  Only entries nearer than twice the radius can take parts from
the ball; these are its neighbours.  A part nearer than half the way to the nearest neighbour lies in the stable core
and keeps its entry unseen; any other lies in a ring between the half-ways of two neighbours and is compared with those
up to it only.  All of that is exact in whole numbers, ties included, so results are those of the plain method.

The integer vectors with their codes are stored between rounds; per task, one row per codebook cell (counts, sums,
farthest distance) is combined before the shuffle, and the driver gets one row per cell: their number depends on the
size of the codebook alone.

Rows whose vector is null, empty, of a length that the number of parts does not divide, or has null or non-finite
components are left out; zero vectors take part.  Each length has codebooks of its own.  Beyond 2**25 whole numbers are
cut off there, so that distances fit 64 bits.  Codebooks begin with the rows of least id (null last, repeated ids by
vector); repeated rows are rows like any other.  With fewer rows than entries there are as many entries as rows.  An
empty table gives no rows.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnline.llm.common import arrow_map, drop_stored, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Whole numbers lie between minus this and this.
LIMIT = 1 << 25
#: Vectors that a worker handles at a time.
SLICE_ROWS = 8192
#: Labels whose sums are broadcast at most (some 20 MB); more are joined by shuffle.
MAX_LABELS = 1_000_000

#: By vector length: entries as (part, entry, component).
Codebooks = dict[int, np.ndarray]


def whole_vectors(vectors: DataFrame, id_column: str, vector_column: str, label_column: str, parts: int, scale: int) -> DataFrame:
    """``vec_id``, ``label``, ``dimension`` and the whole numbers ``x`` of the vectors that take part."""
    v = F.col(vector_column).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).alias("label"),
        F.when(v.isNotNull() & finite, v).alias("v"),
    ).where("size(v) > 0").where(F.size("v") % parts == 0)
    whole = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"))
    return kept.select("vec_id", "label", F.size("v").alias("dimension"), whole.alias("x"))


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> Codebooks:
    order = Window.partitionBy("dimension").orderBy(F.col("vec_id").asc_nulls_last(), "x")
    least = rows.select("dimension", "vec_id", "x").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= entries)
    found: dict[int, list] = {}
    for row in least.orderBy("dimension", "nth").collect():  # as many rows as entries, by length
        found.setdefault(row.dimension, []).append(row.x)
    return {d: np.array(x, np.int64).reshape(len(x), parts, -1).transpose(1, 0, 2) for d, x in found.items()}


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return np.einsum("...i,...i->...", gap, gap)


def nearest_of_all(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest entry of each part position of each vector; ``x`` is (row, part, component)."""
    out = np.empty(x.shape[:2], np.uint8)
    for p in range(x.shape[1]):
        out[:, p] = (np.einsum("ij,ij->i", book[p], book[p]) - 2 * (x[:, p] @ book[p].T)).argmin(axis=1)
    return out


class Balls:
    """Of each part position: every entry's neighbours, nearest first, and the squared ways to them."""

    def __init__(self, book: np.ndarray, radii: np.ndarray):
        apart = squared(book[:, :, None], book[:, None])
        self.book, (parts, entries, _) = book, book.shape
        apart[:, np.arange(entries), np.arange(entries)] = np.iinfo(np.int64).max
        # An entry farther than twice the radius is farther from each part than the ball's own; at twice, it may tie.
        apart[apart > 4 * radii[:, :, None] ** 2] = np.iinfo(np.int64).max
        self.order = np.argsort(apart, axis=2, kind="stable")
        self.ways = np.take_along_axis(apart, self.order, 2)

    def nearest(self, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, int]:
        """New codes, and the number of distances that were worked out beside those to the parts' own entries."""
        out, looked = codes.copy(), 0
        for p, book in enumerate(self.book):
            own = codes[:, p]
            q = squared(x[:, p], book[own])
            at = np.flatnonzero(self.ways[p, own, 0] <= 4 * q)  # outside the stable core
            best, chosen = q[at], own[at].astype(np.int64)
            k = 0
            live = np.arange(len(at))
            while len(live):  # ring by ring: the k-th neighbour concerns parts beyond half the way to it
                rows = at[live]
                other = self.order[p, own[rows], k]
                far = squared(x[rows, p], book[other])
                looked += len(rows)
                better = (far < best[live]) | ((far == best[live]) & (other < chosen[live]))
                best[live[better]], chosen[live[better]] = far[better], other[better]
                k += 1
                if k == self.order.shape[2]:
                    break
                live = live[self.ways[p, own[rows], k] <= 4 * q[rows]]
            out[at, p] = chosen
        return out, looked


def _arrays(batches: Iterator[pa.RecordBatch], parts: int, codes: bool) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray | None]]:
    """Batches of vectors of one length, as (row, part, component), with their codes."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            some = batch.slice(at, SLICE_ROWS)
            dimension = some.column("dimension").to_numpy()
            for d in np.unique(dimension).tolist():
                part = some if (dimension == d).all() else some.filter(pa.array(dimension == d))
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, parts, -1)
                found = None
                if codes:
                    found = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(part.num_rows, parts)
                yield part, d, x, found


def assign(rows: DataFrame, books: Codebooks, balls: dict[int, Balls] | None, parts: int, last: bool = False) -> DataFrame:
    """The rows with new ``codes``; without ``x`` and with the squared ``error`` after the last round."""
    shared = rows.sparkSession.sparkContext.broadcast((books, balls))  # codebooks and their neighbour lists
    kept = ["vec_id", "label", "dimension"]
    extra = [T.StructField("error", T.LongType())] if last else [rows.schema["x"]]
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField("codes", T.BinaryType()), *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, balls = shared.value
        for part, d, x, codes in _arrays(batches, parts, balls is not None):
            codes = nearest_of_all(x, books[d]) if balls is None else balls[d].nearest(x, codes)[0]
            out = [*[part.column(c) for c in kept], pa.array([c.tobytes() for c in codes], pa.binary())]
            if last:
                out.append(pa.array(squared(x, books[d][np.arange(parts), codes]).sum(axis=1)))
            else:
                out.append(part.column("x"))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return arrow_map(rows, run, schema)


def moved(rows: DataFrame, books: Codebooks, parts: int) -> tuple[Codebooks, dict[int, Balls]]:
    """The codebooks after a round, and the balls around their entries."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        cells: dict[int, np.ndarray] = {}
        for _, d, x, codes in _arrays(batches, parts, True):
            entries, width = books[d].shape[1:]
            held = cells.setdefault(d, np.zeros((parts, entries, width + 2), np.int64))
            far = squared(x, books[d][np.arange(parts), codes])
            for p in range(parts):
                np.add.at(held[p, :, :width], codes[:, p], x[:, p])
                held[p, :, width] += np.bincount(codes[:, p], minlength=entries)
                np.maximum.at(held[p, :, width + 1], codes[:, p], far[:, p])
        for d, held in cells.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(held.size, d, np.int32)), pa.array(np.arange(held.size, dtype=np.int32)), pa.array(held.reshape(-1))],
                names=["dimension", "cell", "value"],
            )

    cells = arrow_map(rows.select("dimension", "x", "codes"), run, "dimension int, cell int, value long")
    after, balls = {}, {}
    found: dict[int, list] = {}
    for row in cells.groupBy("dimension", "cell").agg(F.sum("value").alias("total"), F.max("value").alias("most")).collect():
        found.setdefault(row.dimension, []).append((row.cell, row.total, row.most))
    for d, values in found.items():
        book = books[d]
        width = book.shape[2]
        _, total, most = (np.array(c, np.int64).reshape(*book.shape[:2], width + 2) for c in zip(*sorted(values)))
        n = total[:, :, width]
        after[d] = np.where(n[:, :, None] > 0, total[:, :, :width] // np.maximum(n, 1)[:, :, None], book)
        # Whole numbers that are not below the radius and the way.
        root = np.vectorize(lambda q: math.isqrt(q) + 1, otypes=[np.int64])
        balls[d] = Balls(after[d], root(most[:, :, width + 1]) + root(squared(after[d], book)))
    return after, balls


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    by_label = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "label_")
    if by_label.limit(MAX_LABELS + 1).count() <= MAX_LABELS:
        by_label = F.broadcast(by_label)
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("label_")), "left").drop("label_")


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> tuple[DataFrame, Codebooks]:
    """A row per vector that takes part (``vec_id``, ``label``, ``dimension``, ``codes`` as bytes, ``error``), stored,
    and the codebooks."""
    if not 0 < entries <= 256 or rounds < 1:
        raise ValueError("a code is a byte, and there is one round at least")
    rows = stored(whole_vectors(vectors, id_column, vector_column, label_column, parts, scale), "whole")
    books = first_codebooks(rows, parts, entries)
    balls: dict[int, Balls] | None = None
    for _ in range(rounds):
        coded = stored(assign(rows, books, balls, parts), "coded")
        drop_stored(rows)
        rows = coded
        books, balls = moved(rows, books, parts)
    coded = stored(assign(rows, books, balls, parts, last=True), "codes")
    drop_stored(rows)
    return coded, books


def code_rows(coded: DataFrame, books: Codebooks) -> DataFrame:
    """``vec_id``, ``code`` (two hex digits a part), ``error``, ``label_error`` and ``codebooks_sha256``."""
    digests = F.lit(None).cast("string")
    for d, book in sorted(books.items()):
        digests = F.when(F.col("dimension") == d, digest(book)).otherwise(digests)
    return with_label_errors(coded).select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", digests.alias("codebooks_sha256")
    )


def decode(codes: bytes, book: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The vector that a code stands for."""
    return (book[np.arange(len(book)), np.frombuffer(codes, np.uint8)].reshape(-1) + 0.5) / scale
