"""Prefix trie of conversations: a splitter skeleton, and sorted shards that finish all other nodes.

A turn becomes a key of 20 bytes, the MD5 of role and text and the number of words of the text; a conversation becomes
the path of its keys.  Equal paths are one row before anything is sorted: their conversation ids are put in order in
chunks of an id range, in parallel, and the chunks of a path are digested as a stream.

Paths are cut into ranges at splitters, which a bounded sample gives; a splitter is no longer than it takes to differ
from the sampled path before it.  Only prefixes of splitters can have conversations in more than one range: their trie,
the skeleton, is broadcast (at most ``SKELETON_BYTES``).  A task reads its ranges in order and finishes every node
outside the skeleton by itself: the nodes of a sorted range are an interval each, so counts, leaves and sums are
differences of running sums.  For skeleton nodes it gives partial aggregates, which are added up, and then added along
the skeleton's own edges.

A shard holds about ``SHARD_BYTES`` of different paths; of many equal conversations it sees one.  One conversation's
path is one value (20 bytes a turn).  Turns are in order of ``turn``, null first; equal ones by role, then by key, so
repeated rows are turns like any other.  Null roles and texts count as empty, texts of any length are read whole.  Rows
without a conversation id take no part.  An empty table gives no nodes.  Other columns are not read, whatever their
names.  Roles and texts of equal MD5 are taken for the same.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnline.llm.common import arrow_map, drop_stored, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a turn in a path: its key, and the number of words.
KEY, TURN = 16, 20
#: Bytes of different paths in a shard, up to so many shards; sampled paths per shard; bytes of all splitters at most.
SHARD_BYTES, MAX_SHARDS, SAMPLES, SKELETON_BYTES = 256 << 10, 16_384, 8, 16 << 20
#: Conversation ids whose upper bits agree are put in order together.
CHUNK_BITS = 13

NO_ENDS = hashlib.sha256(b"").hexdigest()

NODE = (
    "skeleton int, parent_skeleton int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, words long, ends_sha256 string"
)
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def shared_turns(conv_id: int) -> int:
    """How many turns a conversation takes from the head of its group."""
    return zlib.crc32(str(conv_id).encode()) % 4


def paths_of(conversations: DataFrame, group: int | None = None) -> DataFrame:
    """``path`` and ``conv_id`` of every conversation.

    With ``group``, the first turns of a conversation, ``shared_turns`` of them, are those of the conversation whose id
    is the multiple of ``group`` below (none if there is no such conversation): the turns that a shared beginning has.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.col("conv_id") - F.col("conv_id") % group if group else F.col("conv_id")
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), head.cast("long").alias("head"), F.col("turn"), role.alias("role"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("int").alias("words"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, head_now, head_path = None, [], None, b""

        def close() -> bytes:
            nonlocal head_now, head_path
            conv_id, head_id = now
            path = b"".join(held)
            if not group:
                return path
            if head_id != head_now:
                head_now, head_path = head_id, b""
            if conv_id == head_id:
                head_path = path[: 3 * TURN]
            at = shared_turns(conv_id) * TURN
            return head_path[:at] + path[at:]

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, heads = batch.column("conv_id").to_numpy(), batch.column("head").to_numpy()
            keys = np.frombuffer(b"".join(batch.column("key").to_pylist()), np.uint8).reshape(-1, KEY)
            words = batch.column("words").to_numpy().astype(">u4").view(np.uint8).reshape(-1, TURN - KEY)
            content = np.concatenate([keys, words], axis=1).tobytes()
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]).tolist()
            paths, names = [], []
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                this = int(ids[a]), int(heads[a])
                if this != now:
                    if now is not None:
                        paths.append(close())
                        names.append(now[0])
                    now, held = this, []
                held.append(content[a * TURN : b * TURN])
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.binary()), pa.array(names, pa.int64())], names=["path", "conv_id"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([close()], pa.binary()), pa.array([now[0]], pa.int64())], names=["path", "conv_id"])

    in_order = turns.repartition("head").sortWithinPartitions(
        F.col("head"), F.col("conv_id") != F.col("head"), F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("key")
    )
    return arrow_map(in_order.select("conv_id", "head", "key", "words"), run, "path binary, conv_id long")


def distinct_paths(paths: DataFrame) -> DataFrame:
    """A row per different path: ``n`` conversations, the ``least`` id, and the digest of all ids in order, ``ends``."""
    ids = F.sort_array(F.collect_list("conv_id"))
    chunks = paths.groupBy("path", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(
        F.count("*").alias("n"), F.min("conv_id").alias("least"), F.array_join(ids.cast("array<string>"), ",").alias("ids")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, least, digest = None, 0, 0, hashlib.sha256()
        for batch in batches:
            out = []
            for path, more, low, text in zip(*(batch.column(c).to_pylist() for c in ("path", "n", "least", "ids"))):
                if path == now:
                    n += more
                    digest.update(b",")
                else:
                    if now is not None:
                        out.append((now, n, least, digest.hexdigest()))
                    now, n, least, digest = path, more, low, hashlib.sha256()
                digest.update(text.encode())
            yield _paths(out)
        if now is not None:
            yield _paths([(now, n, least, digest.hexdigest())])

    def _paths(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [(), (), (), ()]
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "n", "least", "ends"])

    in_order = chunks.repartition("path").sortWithinPartitions("path", "chunk")
    return arrow_map(in_order, run, "path binary, n long, least long, ends string")


def shared_depth(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with in common."""
    most = min(len(a), len(b)) // TURN
    if a[:TURN] != b[:TURN]:
        return 0
    if a[: most * TURN] == b[: most * TURN]:
        return most
    low, high = 1, most
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[low * TURN : middle * TURN] == b[low * TURN : middle * TURN] else (low, middle)
    return low


def splitters_of(paths: DataFrame, shard_bytes: int, max_shards: int, skeleton_bytes: int) -> list[bytes]:
    """Rising paths that cut all paths into ranges of about ``shard_bytes``."""
    weight = F.length("path") + TURN
    rows, content = paths.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    shards = min(max_shards, math.ceil(content / shard_bytes))
    if shards < 2:
        return []
    most, scale = skeleton_bytes // shards, 1 << 40
    share = min(scale, scale * SAMPLES * shards // rows)
    sample = paths.where(F.pmod(F.xxhash64("path", F.lit(13)), F.lit(scale)) < share).select("path", weight.alias("weight"))
    aim = content * share / scale / shards

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, passed = None, 0
        for batch in batches:
            found = []
            for path, own in zip(batch.column("path").to_pylist(), batch.column("weight").to_pylist()):
                if before is not None and passed >= aim:
                    short = path[: (shared_depth(before, path) + 1) * TURN]
                    if len(short) <= most:
                        found.append(short)
                        passed = 0
                before, passed = path, passed + own
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["path"])

    # One task reads the sample, some SAMPLES paths per shard.
    cut = sample.repartition(1).sortWithinPartitions("path").mapInArrow(run, "path binary")
    return sorted({bytes(row.path) for row in cut.collect()})


class Skeleton:
    """The trie of the splitters: for each splitter the number of its prefix of every depth, 0 for the root."""

    def __init__(self, splitters: list[bytes]):
        self.splitters = splitters
        self.numbers: list[np.ndarray] = []
        parents, before = [-1], b""
        for splitter in splitters:
            depth = len(splitter) // TURN
            shared = shared_depth(before, splitter) if self.numbers else 0
            own = np.arange(len(parents), len(parents) + depth - shared, dtype=np.int32)
            number = np.concatenate([self.numbers[-1][: shared + 1] if self.numbers else np.zeros(1, np.int32), own])
            parents.extend(number[shared:depth].tolist())
            self.numbers.append(number)
            before = splitter
        self.parents = np.array(parents, np.int32)

    def shard_of(self, path: bytes) -> int:
        return bisect_right(self.splitters, path)

    def along(self, path: bytes, shard: int) -> np.ndarray:
        """Numbers of those prefixes of a path of the shard, by depth, that belong to the skeleton."""
        best = np.zeros(0, np.int32)
        for i in (shard - 1, shard):
            if 0 <= i < len(self.splitters):
                number = self.numbers[i][: shared_depth(path, self.splitters[i]) + 1]
                best = number if len(number) > len(best) else best
        return best


def shard_nodes(paths: list[bytes], n: np.ndarray, least: np.ndarray, ends: list[str], shard: int, skeleton: Skeleton) -> pa.RecordBatch:
    """The nodes of a shard's rising paths, finished ones and partial ones of the skeleton."""
    lengths = np.fromiter((len(p) // TURN for p in paths), np.int64, len(paths))
    shared = np.fromiter((0, *(shared_depth(a, b) for a, b in zip(paths, paths[1:]))), np.int64, len(paths))
    fresh = lengths - shared
    start = 1 + np.cumsum(fresh) - fresh  # the root is node 0; a path's new nodes follow each other
    size = int(1 + fresh.sum())
    depth = np.ones(size, np.int64)
    depth[0] = 0
    depth[1:] = np.arange(1, size) - np.repeat(start, fresh) + np.repeat(shared, fresh) + 1
    tails = np.frombuffer(b"".join(p[s * TURN :] for p, s in zip(paths, shared.tolist())), np.uint8).reshape(-1, TURN)
    words = np.zeros(size, np.int64)
    words[1:] = np.ascontiguousarray(tails[:, KEY:]).view(">u4").reshape(-1)
    parent, end = np.arange(-1, size - 1), np.full(size, size)
    number = np.full(size, -1, np.int64)
    number[0] = 0 if skeleton.splitters else -1
    open_ = np.zeros(int(lengths.max()) + 1, np.int64)
    open_to = 0
    for path, s, d, at in zip(paths, shared.tolist(), lengths.tolist(), start.tolist()):
        end[open_[s + 1 : open_to + 1]] = at
        if d > s:
            parent[at] = open_[s]
            open_[s + 1 : d + 1] = np.arange(at, at + d - s)
        open_to = d
        known = skeleton.along(path, shard)
        if len(known) > s + 1:
            number[at : at + len(known) - s - 1] = known[s + 1 :]
    last = np.where(fresh > 0, start + fresh - 1, 0)
    own, low = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
    own[last], low[last] = n, least
    by_depth = np.argsort(depth, kind="stable")
    bounds = np.searchsorted(depth[by_depth], np.arange(depth.max() + 2))
    for d in range(int(depth.max()), 0, -1):
        at = by_depth[bounds[d] : bounds[d + 1]]
        np.minimum.at(low, parent[at], low[at])

    def within(values: np.ndarray) -> np.ndarray:
        upto = np.r_[0, np.cumsum(values)]
        return upto[end] - upto[:-1]

    plain = number < 0
    children = np.bincount(parent[1:][plain[1:]], minlength=size)
    convs = within(own)
    closed = plain & (np.bincount(parent[1:], minlength=size) == 0)
    text = np.full(size, len(paths))
    text[last] = np.arange(len(paths))
    above = np.where(np.arange(size) > 0, parent, 0)
    to_plain = plain & (np.arange(size) > 0) & plain[above]
    to_skeleton = plain & (np.arange(size) > 0) & ~plain[above]
    return pa.RecordBatch.from_arrays([
        pa.array(number.astype(np.int32), mask=plain), pa.array(number[above].astype(np.int32), mask=~to_skeleton),
        pa.array(low), pa.array(depth), pa.array(low[above], mask=~to_plain), pa.array(convs), pa.array(children),
        pa.array(within(closed.astype(np.int64))), pa.array(within(np.where(plain, (convs - 1) * words, 0))), pa.array(words),
        pa.array([*ends, NO_ENDS], pa.string()).take(pa.array(text)),
    ], names=[c.split()[0] for c in NODE.split(", ")])


def finished(partial: DataFrame, skeleton: Skeleton) -> DataFrame:
    """Skeleton nodes from the sums of their partial aggregates, added along the skeleton's edges in one task: there
    are no more of them than the skeleton has."""
    ends = F.max(F.when(F.col("ends_sha256") != NO_ENDS, F.col("ends_sha256")))
    summed = partial.groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        F.max("words").alias("words"), F.coalesce(ends, F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    shared = partial.sparkSession.sparkContext.broadcast(skeleton.parents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows).combine_chunks()
        names = ("skeleton", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "words")
        own, conv, depth, convs, children, leaves, saved, words = (table.column(c).to_numpy().copy() for c in names)
        place = np.full(len(shared.value) + 1, -1)
        place[own] = np.arange(len(own))
        up = place[shared.value[own]]
        up[depth == 0] = -1
        np.add.at(children, up[up >= 0], 1)
        # The partial sums hold what lies outside the skeleton, of the whole subtree; its own nodes are still to add.
        ends, gains = (children == 0).astype(np.int64), (convs - 1) * words
        by_depth = np.argsort(depth, kind="stable")
        bounds = np.searchsorted(depth[by_depth], np.arange(depth.max() + 2))
        for d in range(int(depth.max()), 0, -1):
            at = by_depth[bounds[d] : bounds[d + 1]]
            np.add.at(ends, up[at], ends[at])
            np.add.at(gains, up[at], gains[at])
        leaves += ends
        saved += gains
        yield pa.RecordBatch.from_arrays([
            pa.array(own), pa.array(np.full(len(own), -1, np.int32), mask=np.ones(len(own), bool)), pa.array(conv), pa.array(depth),
            pa.array(conv[up], mask=up < 0), pa.array(convs), pa.array(children), pa.array(leaves), pa.array(saved), pa.array(words),
            table.column("ends_sha256").combine_chunks(),
        ], names=[c.split()[0] for c in NODE.split(", ")])

    return arrow_map(summed.repartition(1), run, NODE)


def prefix_trie(
    paths: DataFrame, shard_bytes: int = SHARD_BYTES, max_shards: int = MAX_SHARDS, skeleton_bytes: int = SKELETON_BYTES,
) -> DataFrame:
    """A row per node of the trie of ``path`` and ``conv_id`` rows: ``COLUMNS``."""
    known = stored(distinct_paths(paths), "paths")
    skeleton = Skeleton(splitters_of(known, shard_bytes, max_shards, skeleton_bytes))
    shared = paths.sparkSession.sparkContext.broadcast(skeleton)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            shard = pa.array([trie.shard_of(p) for p in batch.column("path").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, shard], names=[*batch.schema.names, "shard"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held, now = shared.value, [], None

        def close() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            return shard_nodes(
                rows.column("path").to_pylist(), rows.column("n").to_numpy(), rows.column("least").to_numpy(),
                rows.column("ends").to_pylist(), now, trie,
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column("shard").to_numpy()
            starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]).tolist()
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                if held and shard[a] != now:
                    yield close()
                    held = []
                now = int(shard[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield close()

    placed = arrow_map(known, place, "path binary, n long, least long, ends string, shard int")
    in_order = placed.repartition("shard").sortWithinPartitions("shard", "path")
    nodes = stored(arrow_map(in_order, grow, NODE), "nodes")
    drop_stored(known)
    top = stored(finished(nodes.where("skeleton is not null"), skeleton), "skeleton")
    heads = top.select(F.col("skeleton").alias("parent_skeleton"), F.col("conv_id").alias("head_conv_id"))
    rest = nodes.where("skeleton is null").join(F.broadcast(heads), "parent_skeleton", "left")
    rest = rest.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "head_conv_id"))
    return rest.select(*COLUMNS).unionByName(top.select(*COLUMNS))
