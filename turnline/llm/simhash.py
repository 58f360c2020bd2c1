"""Near-duplicate vectors: random-hyperplane sign hashes in several tables, exact cosine, components.

A vector gets a code of sign bits in each table; vectors that share a code in any
table are compared by exact cosine in double precision.  The number of bits grows
with the logarithm of the number of vectors, so that few are compared all with all,
and the number of tables follows from it: a pair at the threshold is found with
probability ``recall`` and a closer one with more.  Where there are many vectors, a
table's buckets hold some ten thousand of them, and fine tables of further bits, worked
out where a bucket lies, say which of these are compared; so vectors travel less often.
A bucket beyond ``BLOCK`` vectors is cut into blocks and every pair of blocks is a unit
of work of its own; nothing is left out.

Vectors lie in the shared folder once, as bytes.  Some tables at a time are dealt out
(``tables_at_a_time``), each with every vector in it, and what was shuffled for them is
given back before the next ones, so the disk holds a few times the vectors however many
tables there are.  Codes are not stored: they are worked out where they are needed, in
whole numbers, and so are the same everywhere.

Equal vectors are one node that counts with all its rows.  A pair counts in the first
table, and the first fine table of it, where its codes agree; the units report link counts and a spanning forest, never
pairs.  Vectors that are null, zero, or hold null or non-finite components, and rows
without an id, link with nothing; vectors of different lengths do not link.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnline.llm.common import arrow_map, free_shuffles, stored
from turnline.llm.components import connected_components
from turnline.llm.vectors import is_valid, named

BLOCK = 1 << 17
#: Vectors of a bucket on average, half of it at least: those that are compared all with all where there are no fine
#: tables, and where there are, and those that a bucket then holds.
BUCKET, FINE_BUCKET, UNIT_VECTORS = 1024, 256, 1 << 16
FINE_TABLES = 6
#: Bytes of vectors that a task deals out at a time, that one row holds, and that are shuffled at a time whatever the input.
HELD_BYTES, ROW_BYTES, ROUND_BYTES = 16 << 20, 16 << 10, 128 << 20
#: Tables that are shuffled at a time at least.
LEAST_TABLES = 2
#: Cosines that are looked at together, and pairs that are counted together.
TILE, PAIRS = 1 << 20, 1 << 18


@dataclass(frozen=True)
class Shape:
    bits: int
    tables: int
    fine_bits: int
    fine_tables: int
    seed: int


def bits_for(n_vectors: int, bucket: int) -> int:
    return math.ceil(math.log2(max(n_vectors, 2) / bucket))


def shape(n_vectors: int, threshold: float, recall: float, seed: int) -> Shape:
    bits, fine_bits, fine_tables = max(4, bits_for(n_vectors, BUCKET)), 0, 0
    agree = 1 - math.acos(threshold) / math.pi
    found = agree**bits
    if n_vectors > 4 * UNIT_VECTORS:
        bits, fine_tables = max(2, bits_for(n_vectors, UNIT_VECTORS)), FINE_TABLES
        fine_bits = min(max(1, bits_for(n_vectors, FINE_BUCKET) - bits), 31)
        found = agree**bits * (1 - (1 - agree**fine_bits) ** fine_tables)
    return Shape(bits, math.ceil(math.log(1 - recall) / math.log(1 - found)), fine_bits, fine_tables, seed)


def tables_at_a_time(vector_bytes: int) -> int:
    """How many times all vectors may be in a shuffle at once."""
    return max(LEAST_TABLES, ROUND_BYTES // max(vector_bytes, 1))


@functools.lru_cache(4)
def planes(dimension: int, by: Shape) -> np.ndarray:
    """Directions in whole numbers below 2^14, by table: those of its code, then those of its fine tables."""
    width = by.bits + by.fine_tables * by.fine_bits
    drawn = np.random.default_rng([by.seed, dimension]).standard_normal((dimension, by.tables, width))
    return np.rint(drawn * 1024)


def codes_of(vectors: np.ndarray, first: int, last: int, by: Shape, fine: bool = False) -> np.ndarray:
    """The codes in the tables from ``first`` to before ``last``, each followed by its fine codes if wanted; components are
    rounded to 2^-20 of the largest one, so the sums are exact in any order."""
    n, d = vectors.shape
    width = by.bits + (by.fine_tables * by.fine_bits if fine else 0)
    directions = planes(d, by)[:, first:last, :width].reshape(d, -1)
    out = np.empty((n, last - first, 1 + (by.fine_tables if fine else 0)), np.int32)
    step = max(1, TILE // max(directions.shape[1], d))
    for at in range(0, n, step):
        some = vectors[at:at + step].astype(np.float64)
        some = np.rint(some / np.abs(some).max(axis=1)[:, None] * (1 << 20))
        sign = (some @ directions > 0).reshape(len(some), last - first, width)
        out[at:at + step, :, 0] = sign[:, :, :by.bits] @ (2.0 ** np.arange(by.bits))
        if fine and by.fine_tables:
            parts = sign[:, :, by.bits:].reshape(len(some), last - first, by.fine_tables, by.fine_bits)
            out[at:at + step, :, 1:] = parts @ (2.0 ** np.arange(by.fine_bits))
    return out


def held_vectors(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Nodes, sizes and vectors of one length, some ``HELD_BYTES`` at a time."""
    held: dict[int, list[pa.RecordBatch]] = {}
    size = 0

    def close():
        for length, parts in held.items():
            rows = pa.Table.from_batches(parts)
            yield (rows.column("node").to_numpy(), rows.column("size").to_numpy(),
                   np.frombuffer(b"".join(rows.column("vector").to_pylist()), kind).reshape(rows.num_rows, -1))

    for batch in batches:
        lengths = pc.binary_length(batch.column("vector")).to_numpy().astype(np.int64)
        for length in np.unique(lengths).tolist():
            held.setdefault(length, []).append(batch.filter(pa.array(lengths == length)))
        size += int(lengths.sum())
        if size >= HELD_BYTES:
            yield from close()
            held, size = {}, 0
    yield from close()


def packed(nodes: DataFrame, kind: str) -> DataFrame:
    """Vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
            ends = np.r_[0, np.cumsum(column.value_lengths().to_numpy())].astype(np.int32) * flat.itemsize
            data = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], data], names=["node", "size", "least", "vector"])

    return arrow_map(nodes.select("node", "size", "least", "vector"), run, "node long, size long, least long, vector binary")


def large_buckets(
    nodes: DataFrame, kind: str, by: Shape, block: int,
) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """By table and dimension the codes (sorted) of buckets that may pass ``block`` vectors, and the number of blocks of each.

    A task leaves out codes that it meets less often than ``least`` times; all tasks leave out less than half a block of
    a code.  So what comes to the driver is bounded by two rows per block of vectors and table.
    """
    parts = max(1, nodes.rdd.getNumPartitions())
    least = max(1, block // (2 * parts))
    left_out = parts * (least - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], np.ndarray] = {}
        for _, _, vectors in held_vectors(batches, kind):
            codes = codes_of(vectors, 0, by.tables, by)[:, :, 0]
            for t in range(by.tables):
                n = np.bincount(codes[:, t], minlength=1 << by.bits).astype(np.int32)
                counts[t, vectors.shape[1]] = n + counts.get((t, vectors.shape[1]), 0)
        for (t, d), n in counts.items():
            at = np.flatnonzero(n >= least)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), x, np.int32)) for x in (t, d)] + [pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))],
                names=["table", "dimension", "code", "n"],
            )

    some = arrow_map(nodes, run, "table int, dimension int, code int, n long")
    found = some.groupBy("table", "dimension", "code").agg(F.sum("n").alias("n")).where(F.col("n") > block - left_out)
    out: dict = {}
    for r in sorted(found.collect()):
        out.setdefault((r.table, r.dimension), []).append((r.code, math.ceil((r.n + left_out) / block)))
    return {key: tuple(np.array(x) for x in zip(*rows)) for key, rows in out.items()}


UNIT = ["table", "code", "dimension", "low", "high"]
DEALT = ", ".join(f"{c} int" for c in [*UNIT, "block"]) + ", nodes binary, sizes binary, vectors binary"


def binaries(rows: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of runs of rows."""
    rows = np.ascontiguousarray(rows)
    ends = (bounds * (rows.nbytes // max(len(rows), 1))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def dealt(
    nodes: DataFrame, kind: str, first: int, last: int, by: Shape,
    large: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]],
) -> DataFrame:
    """Every vector in its unit of each table from ``first`` to before ``last``: many of a unit in a row, a unit's rows
    next to each other.  A vector of a large bucket is in as many units as that has blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, size, vectors in held_vectors(batches, kind):
            d = vectors.shape[1]
            codes = codes_of(vectors, first, last, by)[:, :, 0]
            for t in range(first, last):
                code = codes[:, t - first]
                blocks, block, other, at = np.ones(len(code), np.int64), np.zeros(len(code), np.int64), np.zeros(len(code), np.int64), np.arange(len(code))
                if (t, d) in large:
                    known, n = large[t, d]
                    place = np.minimum(np.searchsorted(known, code), len(known) - 1)
                    blocks = np.where(known[place] == code, n[place], 1)
                    at = np.repeat(at, blocks)
                    other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    block = ((node.view(np.uint64) >> np.uint64(32)) % blocks.astype(np.uint64)).astype(np.int64)[at]
                low, high, code = np.minimum(block, other), np.maximum(block, other), code[at]
                order = np.lexsort((block, high, low, code)) if (t, d) in large else np.argsort(code, kind="stable")
                keys = np.stack([code, low, high, block])[:, order]
                new = np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)]
                # Runs of one unit and block, none of more than ROW_BYTES.
                starts = np.flatnonzero(new)
                within = np.arange(len(order)) - starts[np.cumsum(new) - 1]
                starts = np.flatnonzero(within % max(1, ROW_BYTES // (d * vectors.itemsize)) == 0)
                for some in range(0, len(starts), 1024):
                    cut = np.r_[starts[some:some + 1025], len(order)][:1025]
                    rows = at[order[cut[0]:cut[-1]]]
                    code_, low_, high_, block_ = keys[:, cut[:-1]].astype(np.int32)
                    same = [np.full(len(code_), x, np.int32) for x in (t, d)]
                    yield pa.RecordBatch.from_arrays(
                        [*map(pa.array, (same[0], code_, same[1], low_, high_, block_)),
                         *(binaries(x[rows], cut - cut[0]) for x in (node, size, vectors))],
                        names=[*UNIT, "block", "nodes", "sizes", "vectors"],
                    )

    return arrow_map(nodes, run, DEALT).repartition(*UNIT).sortWithinPartitions(*UNIT)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's component, from pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """The directions in double precision."""
    v = vectors / np.abs(vectors).max(axis=1).astype(np.float64)[:, None]
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def near_pairs(vectors: np.ndarray, single: np.ndarray, left: np.ndarray, right: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of vectors whose cosine in double precision reaches the threshold: each of the left with each other one
    (``right`` is None), or with those of the right.  Single precision (``single``, the directions) tells most of them;
    what is within its error of the threshold is worked out again."""
    # Rounding of either vector's components, and of as many products and sums as there are.
    error = (vectors.shape[1] + 4) * 2.0 ** -23
    left_ = single[left]
    right_ = left_ if right is None else single[right]
    step = max(1, TILE // max(1, len(right_)))
    for at in range(0, len(left_), step):
        from_ = at if right is None else 0
        cosine = left_[at:at + step] @ right_[from_:].T
        found = np.flatnonzero(cosine.reshape(-1) >= threshold - error)
        a, b = np.divmod(found, cosine.shape[1])
        if right is None:
            kept = b > a
            a, b, found = a[kept], b[kept], found[kept]
        sure = cosine.reshape(-1)[found] >= threshold + error
        a, b = left[a + at], (left if right is None else right)[b + from_]
        unsure = np.flatnonzero(~sure)
        for some in range(0, len(unsure), 1 << 14):
            some = unsure[some:some + (1 << 14)]
            sure[some] = np.einsum("ij,ij->i", unit_vectors(vectors[a[some]]), unit_vectors(vectors[b[some]])) >= threshold
        yield a[sure], b[sure]


def together(left: np.ndarray, right: np.ndarray | None, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """The left, or the left and the right, by code."""

    def by_code(members: np.ndarray) -> dict[int, np.ndarray]:
        order = members[np.argsort(codes[members], kind="stable")]
        starts = np.flatnonzero(np.r_[True, codes[order][1:] != codes[order][:-1]])[: len(order)]
        return dict(zip(codes[order[starts]].tolist(), np.split(order, starts[1:])))

    lefts = by_code(left)
    rights = by_code(right) if right is not None else {}
    for code, members in lefts.items():
        if right is None and len(members) > 1:
            yield members, None
        elif code in rights:
            yield members, rights[code]


def unit_links(rows: pa.Table, kind: str, key: tuple[int, ...], threshold: float, by: Shape) -> pa.RecordBatch | None:
    """Link counts and a spanning forest of one unit: a bucket, or two of its blocks."""
    table, _, dimension, low, high = key
    parts = rows.column("nodes").to_pylist()
    node, size = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.int64) for c in ("nodes", "sizes"))
    vectors = np.frombuffer(b"".join(rows.column("vectors").to_pylist()), kind).reshape(-1, dimension)
    single = np.empty(vectors.shape, np.float32)
    for at in range(0, len(vectors), 4096):
        single[at:at + 4096] = unit_vectors(vectors[at:at + 4096])
    left, right = np.arange(len(vectors)), None
    if low != high:
        block = np.repeat(rows.column("block").to_numpy(), [len(x) // 8 for x in parts])
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    links, label = np.zeros(len(vectors)), np.arange(len(vectors))

    def count(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal links, label
        new = not_met(vectors, a, b, table, by)
        a, b = a[new], b[new]
        links += np.bincount(a, size[b], len(vectors)) + np.bincount(b, size[a], len(vectors))
        apart = label[a] != label[b]
        if apart.any():
            label = roots(len(vectors), label[a[apart]], label[b[apart]])[label]

    def counted(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
        """Some pairs at a time."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for a, b in pairs:
            for at in range(0, len(a), PAIRS):
                held.append((a[at:at + PAIRS], b[at:at + PAIRS]))
                n += len(held[-1][0])
                if n >= PAIRS:
                    count(*map(np.concatenate, zip(*held)))
                    held, n = [], 0
        if n:
            count(*map(np.concatenate, zip(*held)))

    if not by.fine_tables:
        counted(near_pairs(vectors, single, left, right, threshold))
    else:
        codes = codes_of(vectors, table, table + 1, by, fine=True)[:, 0, 1:]

        def found(k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for some, others in together(left, right, codes[:, k]):
                for a, b in near_pairs(vectors, single, some, others, threshold):
                    if k and len(a):
                        new = ~(codes[a, :k] == codes[b, :k]).any(axis=1)
                        a, b = a[new], b[new]
                    yield a, b

        for k in range(by.fine_tables):
            counted(found(k))
    at = np.flatnonzero(links)
    if not len(at):
        return None
    return pa.RecordBatch.from_arrays(
        [pa.array(node[at]), pa.array(links[at].astype(np.int64)), pa.array(node[label[at]])], names=["node", "links", "root"],
    )


def not_met(vectors: np.ndarray, a: np.ndarray, b: np.ndarray, table: int, by: Shape) -> np.ndarray:
    """Which pairs have no code in common in an earlier table; most are in one of the first."""
    left = np.arange(len(a))
    for first in range(0, table, 4):
        if not len(left):
            break
        which, back = np.unique(np.concatenate([a[left], b[left]]), return_inverse=True)
        codes = codes_of(vectors[which], first, min(first + 4, table), by, fine=True)
        x, y = back[:len(left)], back[len(left):]
        new = np.ones(len(left), bool)
        for at in range(0, len(left), 1 << 14):
            same = codes[x[at:at + (1 << 14)]] == codes[y[at:at + (1 << 14)]]
            met = same[:, :, 0] & same[:, :, 1:].any(axis=2) if by.fine_tables else same[:, :, 0]
            new[at:at + (1 << 14)] = ~met.any(axis=1)
        left = left[new]
    return left


def links_of(units: DataFrame, kind: str, threshold: float, by: Shape) -> DataFrame:
    """``node``, ``links`` and ``root`` of every unit; a unit's rows are next to each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def close():
            rows = pa.Table.from_batches(held)
            if rows.num_rows > 1 or len(rows.column("nodes")[0].as_py()) > 8:
                return unit_links(rows, kind, key, threshold, by)

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in UNIT])
            starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)]) if batch.num_rows else []
            for a, b in zip(starts, np.r_[starts[1:], batch.num_rows].astype(int)):
                now = tuple(keys[:, a].tolist())
                if now != key:
                    if held and (found := close()) is not None:
                        yield found
                    held, key = [], now
                held.append(batch.slice(int(a), int(b - a)))
        if held and (found := close()) is not None:
            yield found

    return arrow_map(units, run, "node long, links long, root long")


def near_vectors(
    vectors: DataFrame, threshold: float = 0.9, recall: float = 0.999, seed: int = 7, block: int = BLOCK,
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """The id column, ``n_links``, ``component_id`` and ``kept`` of every row."""
    given = vectors.schema[vector_column].dataType
    single = isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType)
    kind, spark_kind, item = ("<f4", "array<float>", 4) if single else ("<f8", "array<double>", 8)
    rows = named(vectors, id_column, vector_column).withColumn("vector", F.col("vector").cast(spark_kind))
    nodes = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("id").alias("least"), F.first("vector").alias("vector"))
    nodes = stored(packed(nodes, kind), "vectors")
    spark = vectors.sparkSession
    free_shuffles(spark)
    n_nodes, n_bytes = nodes.agg(F.count("*"), F.coalesce(F.sum(F.length("vector")), F.lit(0))).first()
    by = shape(n_nodes, threshold, recall, seed)
    light = nodes.select("node", "size", "vector")
    large = large_buckets(light, kind, by, block)
    step = tables_at_a_time(n_bytes)
    found = []
    for first in range(0, by.tables, step):
        units = dealt(light, kind, first, min(first + step, by.tables), by, large)
        found.append(stored(links_of(units, kind, threshold, by), "links"))
        del units
        free_shuffles(spark)
    found = functools.reduce(DataFrame.unionByName, found)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b"))
    known = nodes.select("node", "size", "least").join(links, "node", "left").join(labels, "node", "left")
    known = known.where("size > 1 or links is not null").withColumn("label", F.coalesce("label", "node"))
    heads = known.groupBy("label").agg(F.min("least").alias("component_id"))
    named_nodes = stored(
        known.join(heads, "label").select("node", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id"),
        "near",
    )
    plain = F.transform(F.col(vector_column).cast("array<double>"), lambda x: x + F.lit(0.0))

    every = vectors.select(
        F.col(id_column).alias("vec_id"),
        F.when(is_valid(F.col(vector_column).cast("array<double>")) & F.col(id_column).isNotNull(), F.xxhash64(plain)).alias("node"),
    )
    out = every.join(named_nodes, "node", "left").select(
        F.col("vec_id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", F.col("vec_id").cast("long")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(False)))
