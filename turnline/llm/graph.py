"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Vectors are dealt out to shards of about ``SHARD`` by hash, among vectors of the same dimension and of like length: a
band holds lengths within a factor of ``RATIO`` (sparse bands are joined to neighbours up to ``LEAST`` vectors).  Within
a shard a graph is built in growing batches: a greedy search from the middle of the shard proposes the neighbours of
each new vector, relaxed distance pruning keeps a diverse few of them, and the reverse edges are added and pruned
likewise.  Queries are searched by beam in the shards; the best of all shards are merged.

The largest inner product is found as the least distance after one more component that makes all vectors of a shard
equally long.  Where lengths differ much, that component rules the distances and edges lead nowhere, so bands matter.
They also spare work: queries go to the longest bands first, and then only to shards whose longest vector could still
reach the ``k``-th best product found there.

Queries travel to the shards: a task reads a shard's graph once and then the queries that ask it, in blocks of
``QUERY_BLOCK``, so the shuffle grows with the vectors plus queries times shards.

Scores are inner products of the original vectors in double precision; ties go to the smaller id.  Equal vectors are one
node with its ``k + 1`` least ids, which is all that a result can show; repeated rows are one candidate.  Vectors that
are null, zero or hold null or non-finite components, and rows without an id take no part.  Vectors of each dimension
are neighbours of none but each other.  Every valid row is indexed; nothing is sampled.  An empty table gives no rows.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnline.llm.common import arrow_map, drop_stored, stored
from turnline.llm.vectors import matrix, named

SHARD = 16_384
#: Out-edges after pruning, room for reverse edges, beam widths, relaxation of the pruning.
DEGREE, ROOM, BUILD_BEAM, SEARCH_BEAM, RELAX = 32, 48, 64, 224, 1.2
BATCH, SEARCHED, EXPAND = 512, 512, 4
#: Lengths of a band, vectors of a band at least, and vectors of the longest bands that all queries are searched in.
RATIO, LEAST, FIRST = 1.08, 256, 4096
#: Queries that a shard's graph is read for at a time.
QUERY_BLOCK = 16_384


def lifted(v: np.ndarray) -> np.ndarray:
    """Points of length one whose distances to a query order as its inner products with the vectors."""
    lengths = np.linalg.norm(v, axis=1)
    short = lengths / lengths.max()
    return np.c_[v / lengths.max(), np.sqrt(np.maximum(1 - short * short, 0))].astype(np.float32)


def directions(q: np.ndarray) -> np.ndarray:
    """Queries as points: only their direction matters."""
    return np.c_[q / np.linalg.norm(q, axis=1)[:, None], np.zeros(len(q))].astype(np.float32)


def beam_search(points: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest points found for each query and their squared distances, nearest first; -1 where fewer were found."""
    q, n = len(queries), len(points)
    ids = np.full((q, beam), -1, np.int64)
    far = np.full((q, beam), np.inf, np.float32)
    done = np.ones((q, beam), bool)
    ids[:, 0], done[:, 0] = start, False
    far[:, 0] = ((queries - points[start]) ** 2).sum(axis=1)
    seen = np.full(q * n, -1, np.int32)
    seen[np.arange(q) * n + start] = 0
    live = np.arange(q)
    while len(live):
        open_ = ~done[live]
        rank = np.cumsum(open_, axis=1)
        pick = open_ & (rank <= EXPAND)
        r, c = np.nonzero(pick)
        owner = live[r]
        done[owner, c] = True
        near = edges[ids[owner, c]]
        slot = (rank[r, c] - 1)[:, None] * near.shape[1] + np.arange(near.shape[1])
        who = np.repeat(r, near.shape[1])
        flat, place = near.reshape(-1), slot.reshape(-1)
        ok = flat >= 0
        who, flat, place = who[ok], flat[ok], place[ok]
        spot = live[who] * n + flat
        fresh = seen[spot] < 0
        who, flat, place, spot = who[fresh], flat[fresh], place[fresh], spot[fresh]
        number = np.arange(len(spot), dtype=np.int32)
        seen[spot] = number
        once = seen[spot] == number
        who, flat, place = who[once], flat[once], place[once]
        gap = points[flat] - queries[live[who]]
        width = EXPAND * near.shape[1]
        new_ids = np.full((len(live), width), -1, np.int64)
        new_far = np.full((len(live), width), np.inf, np.float32)
        new_ids[who, place] = flat
        new_far[who, place] = np.einsum("ij,ij->i", gap, gap)
        all_far = np.concatenate([far[live], new_far], axis=1)
        best = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(all_far, best, 1), axis=1, kind="stable"), 1)
        far[live] = np.take_along_axis(all_far, best, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], new_ids], axis=1), best, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], new_ids < 0], axis=1), best, 1)
        live = live[~done[live].all(axis=1)]
    return ids, far


def robust_prune(points: np.ndarray, centre: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Diverse neighbours of each centre out of its candidates (-1: none); repeated candidates count once."""
    at = points[np.maximum(candidates, 0)]
    gap = at - points[centre][:, None]
    far = np.einsum("ijk,ijk->ij", gap, gap)
    far[(candidates < 0) | (candidates == centre[:, None])] = np.inf
    order = np.argsort(far, axis=1, kind="stable")
    far, candidates = np.take_along_axis(far, order, 1), np.take_along_axis(candidates, order, 1)
    at = np.take_along_axis(at, order[:, :, None], 1)
    squares = np.einsum("ijk,ijk->ij", at, at)
    out = np.full((len(centre), degree), -1, np.int64)
    rows = np.arange(len(centre))
    for k in range(degree):
        first = np.argmax(far < np.inf, axis=1)
        found = far[rows, first] < np.inf
        if not found.any():
            break
        out[found, k] = candidates[found, first[found]]
        chosen = at[rows, first]
        to_chosen = squares + squares[rows, first][:, None] - 2 * np.einsum("ijk,ik->ij", at, chosen)
        far[found[:, None] & (relax * relax * to_chosen <= far + 1e-6)] = np.inf
        far[rows, first] = np.inf
    return out


def build_graph(points: np.ndarray, seed: int = 3) -> tuple[np.ndarray, int]:
    """Edges (-1: none) and the point that searches start from."""
    n = len(points)
    middle = points.mean(axis=0)
    start = int(((points - middle) ** 2).sum(axis=1).argmin())
    edges = np.full((n, ROOM), -1, np.int64)
    degree = np.zeros(n, np.int64)
    order = np.random.default_rng(seed).permutation(n)
    order = order[order != start]
    at, size = 0, 1
    while at < len(order):
        new = order[at : at + size]
        found, _ = beam_search(points, edges, start, points[new], BUILD_BEAM)
        chosen = robust_prune(points, new, found, DEGREE, RELAX)
        edges[new, :DEGREE] = chosen
        degree[new] = (chosen >= 0).sum(axis=1)
        source = np.repeat(new, DEGREE)
        target = chosen.reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        while len(target):
            heads = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
            nth = np.arange(len(target)) - np.repeat(heads, np.diff(np.r_[heads, len(target)]))
            fits = degree[target] + nth < ROOM
            edges[target[fits], (degree[target] + nth)[fits]] = source[fits]
            np.add.at(degree, target[fits], 1)
            source, target = source[~fits], target[~fits]
            if len(target):
                full = np.unique(target)
                kept = robust_prune(points, full, edges[full], DEGREE, RELAX)
                edges[full] = -1
                edges[full, :DEGREE] = kept
                degree[full] = (kept >= 0).sum(axis=1)
        at += len(new)
        size = min(2 * size, BATCH)
    return edges, start


def pack(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def length_of(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x))


def band_of(length: Column) -> Column:
    kept = F.least(F.greatest(length, F.lit(1e-300)), F.lit(1e300))
    return F.floor(F.log(kept) / math.log(RATIO)).cast("int")


def joined_bands(bands: list[tuple[int, int, int, float]], shard: int) -> list[tuple[int, int, int, int, float, bool]]:
    """From (dimension, band, vectors, longest): (dimension, band, first shard, shards, longest, asked first), where
    sparse neighbouring bands share their shards."""
    out, number = [], 0
    for dimension in sorted({d for d, *_ in bands}):
        groups: list[list] = []
        for _, band, n, longest in sorted((b for b in bands if b[0] == dimension), key=lambda b: -b[1]):
            if groups and groups[-1][1] < LEAST:
                groups[-1][0].append(band)
                groups[-1][1] += n
            else:
                groups.append([[band], n, longest])
        if len(groups) > 1 and groups[-1][1] < LEAST:
            own, n, _ = groups.pop()
            groups[-1][0].extend(own)
            groups[-1][1] += n
        passed = 0
        for own, n, longest in groups:
            shards = math.ceil(n / shard)
            out.extend((dimension, band, number, shards, longest, passed < FIRST) for band in own)
            number, passed = number + shards, passed + n
    return out


def build_shards(nodes: DataFrame, bands: DataFrame) -> DataFrame:
    """A row per shard: vectors, edges, start, and the ids of each node."""

    def run(key, table):
        table = table.sort_by("node")
        v = matrix(table.column("vector").combine_chunks())
        edges, start = build_graph(lifted(v))
        ids = table.column("ids").combine_chunks()
        return pa.table({
            "shard": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(v)], pa.int32()),
            "start": pa.array([start], pa.int32()), "vectors": pa.array([pack(v)], pa.binary()),
            "edges": pa.array([pack(edges.astype(np.int32))], pa.binary()),
            "id_counts": pa.array([pack(ids.value_lengths().to_numpy().astype(np.int64))], pa.binary()),
            "ids": pa.array([pack(ids.flatten().to_numpy().astype(np.int64))], pa.binary()),
        })

    # A shard's hash is uniform, so its size is bounded; the order within it fixes the graph.
    within = F.pmod(F.xxhash64("node", F.lit(11)), "shards").cast("int")
    placed = nodes.join(F.broadcast(bands), ["dimension", "band"]).withColumn("shard", F.col("first") + within)
    return placed.select("shard", "node", "vector", "ids").groupBy("shard").applyInArrow(
        run, "shard int, n int, start int, vectors binary, edges binary, id_counts binary, ids binary"
    )


def search_shards(index: DataFrame, asked: DataFrame, blocks: int, tasks: int, k: int, beam: int) -> DataFrame:
    """The ``k`` best of every asked shard for every query: ``query_id``, ``vec_id``, ``score``.

    ``asked`` has ``shard``, ``id`` and ``vector``.  A shard's graph comes first in its partition, then its queries.
    """
    graph = index.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "id": F.lit(None).cast("long"), "vector": F.lit(None).cast("array<double>")})
    empty = {f.name: F.lit(None).cast(f.dataType) for f in index.schema.fields if f.name != "shard"}
    questions = asked.select("shard", "id", "vector").withColumns(
        {**empty, "block": F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks)).cast("int")}
    )
    # Shards that nobody asks are not read.
    wanted = graph.join(questions.select("shard", "block").distinct(), ["shard", "block"], "left_semi")
    rows = wanted.unionByName(questions).repartition(tasks, "shard", "block").sortWithinPartitions(
        F.col("shard"), F.col("block"), F.col("id").asc_nulls_first()
    )

    def search(shard: dict, own: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        v, counts, ids, starts = shard["v"], shard["counts"], shard["ids"], shard["starts"]
        found, _ = beam_search(shard["points"], shard["edges"], shard["start"], directions(q), max(beam, k + 1))
        out: list[tuple] = []
        for i, nodes in enumerate(found):
            nodes = nodes[nodes >= 0]
            score = v[nodes] @ q[i]
            times = counts[nodes]
            which = np.repeat(starts[nodes] - np.cumsum(times) + times, times) + np.arange(times.sum())
            names, scores = ids[which], np.repeat(score, times)
            names, scores = names[names != own[i]], scores[names != own[i]]
            best = np.lexsort((names, -scores))[:k]
            out.append((np.full(len(best), own[i]), names[best], scores[best]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "vec_id", "score"])

    def opened(row: dict) -> dict:
        v = np.frombuffer(row["vectors"], np.float64).reshape(row["n"], -1)
        counts = np.frombuffer(row["id_counts"], np.int64)
        return {
            "v": v, "points": lifted(v), "edges": np.frombuffer(row["edges"], np.int32).reshape(row["n"], -1).astype(np.int64),
            "start": row["start"], "counts": counts, "starts": np.cumsum(counts) - counts, "ids": np.frombuffer(row["ids"], np.int64),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: dict = {}
        for batch in batches:
            is_graph = batch.column("n").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(is_graph)
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a < b and is_graph[a]:
                    shard = opened(batch.slice(a, 1).to_pylist()[0])
                    a += 1
                for at in range(a, b, SEARCHED):
                    some = batch.slice(at, min(SEARCHED, b - at))
                    yield search(shard, some.column("id").to_numpy(), matrix(some.column("vector")))

    return arrow_map(rows, run, "query_id long, vec_id long, score double")


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, shard: int = SHARD, beam: int = SEARCH_BEAM,
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` largest inner products found for every query row."""
    spark = vectors.sparkSession
    rows = named(vectors, id_column, vector_column).withColumns({"dimension": F.size("vector"), "length": length_of(F.col("vector"))})
    # Of equal vectors only the least ids can be seen in a result; the window keeps no more than those per task.
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("nth") <= k + 1)
    first = [F.first(c).alias(c) for c in ("vector", "dimension", "length")]
    nodes = stored(
        ranked.groupBy("node").agg(*first, F.sort_array(F.collect_list("id")).alias("ids")).withColumn("band", band_of(F.col("length"))),
        "vectors",
    )
    # One row per dimension and band of lengths.
    counted = nodes.groupBy("dimension", "band").agg(F.count("*").alias("n"), F.max("length").alias("longest"))
    plan = joined_bands([tuple(r) for r in counted.collect()], shard)
    bands = spark.createDataFrame(plan, "dimension int, band int, first int, shards int, longest double, early boolean")
    index = stored(build_shards(nodes, bands), "index")
    drop_stored(nodes)
    every = bands.groupBy("dimension", "first", "shards", "early").agg(F.max("longest").alias("longest")).withColumn(
        "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("shards") - 1))
    ).select(F.col("dimension").alias("dimension_"), "shard", "longest", "early")
    queries = stored(rows.where(is_query).select("id", "vector", "dimension", "length").distinct(), "queries")
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    numbers = {first + i: early for _, _, first, shards, _, early in plan for i in range(shards)}

    def asking(early: bool, of: DataFrame) -> DataFrame:
        some = F.broadcast(every.where(F.col("early") == early))  # a row per shard
        return of.join(some, F.col("dimension") == F.col("dimension_"))

    def tasks(early: bool) -> int:
        return min(4096, max(1, blocks * sum(e == early for e in numbers.values())))

    found = search_shards(index, asking(True, queries), blocks, tasks(True), k, beam)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if not all(numbers.values()):
        found = stored(found, "found")
        least = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
        # An inner product is no larger than the product of both lengths.
        reach = F.col("length") * F.col("longest") * (1 + 1e-9)
        rest = asking(False, queries.join(least, "id", "left")).where(F.col("least").isNull() | (reach >= F.col("least")))
        found = found.unionByName(search_shards(index, rest, blocks, tasks(False), k, beam))
    return found.select("query_id", F.row_number().over(best).cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
