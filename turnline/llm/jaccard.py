"""Jaccard join of word-shingle sets by universe partitions and the pigeonhole principle.

Sets are banded by size.  The shingle universe of a band is hashed into segments,
about nine per twenty shingles of its largest sets.  Two sets that reach the threshold
differ in few shingles, each of which spoils one segment; so of the non-empty
segments of either set, all but ``errors`` are equal in both.  A segment subset is
hashed to a key.  A set is indexed under all its keys; any partner shares all but
``errors`` of them.  That leaves room for costs: keys of more than ``HOT`` different sets
are skipped for every set that has ``errors + 1`` other keys, since those must meet its
partners; only sets without so many are compared under hot keys.  A set with no more
non-empty segments than errors is indexed under their one-deletion neighbourhoods too, so
that each allows one error more; the very few sets for which even that is not enough share
one key per band.

Sets at the lower end of a band are indexed under the band below as well.  All pairs of a
key that is not hot are candidates.  Under hot keys, sets are first compared with the least
one of the key; what hot keys hold together is then compared block by block, but only sets
of different components: no link that joins two components is lost, and pairs within a
component need no look.  Candidates are compared by sketches first, counts of shingles per
hash range, whose difference is never more than that of the sets and so rules out most;
then by the sets themselves, exactly.  Equal sets are one node.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; texts below five words are one
shingle; null, empty and blank texts have none and link with nothing.  Shingles, sets
and keys are 64-bit hashes.  Repeated rows are copies like any others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnline.llm.common import arrow_map, as_bytes, drop_stored, hashed, slices, stored, words_of
from turnline.llm.components import connected_components

SHINGLE = 5
#: Different sets of a key up to which all its pairs are candidates.
HOT = 8
#: Bits of the filter that spares the sets of documents without candidates (2 MB, whatever the input).
FILTER_BITS = 24
#: Bytes of text whose sets a worker holds at a time.
SET_BYTES = 4 << 20
#: Sets of a block; sets under hot keys are compared block by block.
BLOCK = 1024

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_starts(largest: int) -> list[int]:
    """Sizes at which bands begin; a partner of a set lies in its own band or the next."""
    starts = [1]
    while starts[-1] <= largest:
        starts.append(starts[-1] * 64 // 27 + 1)
    return starts


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All distinct shingles, sorted within each text; bounds of the texts in them; a hash of each set."""
    distinct, number, bounds = words_of(texts)
    words = hashed(distinct, xxhash.xxh3_64_intdigest)[number]
    starts, counts = bounds[:-1], np.diff(bounds)
    rolled = np.zeros(max(len(words) - SHINGLE + 1, 0), np.uint64)
    for k in range(SHINGLE):
        rolled += words[k : k + len(rolled)] * ODD[k]
    rolled = mix(rolled)
    sets = []
    for at, n in zip(starts.tolist(), counts.tolist()):
        if n >= SHINGLE:
            found = np.sort(rolled[at : at + n - SHINGLE + 1])
            sets.append(found[np.r_[True, found[1:] != found[:-1]]])
        elif n:
            short = (words[at : at + n] * ODD[:n]).sum(dtype=np.uint64) + np.uint64(n)
            sets.append(mix(np.array([short ^ np.uint64(0x5555555555555555)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    bounds = np.r_[0, np.cumsum(sizes)]
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    sums = np.zeros(len(sets), np.uint64)
    np.add.at(sums, np.repeat(np.arange(len(sets)), sizes), mix(flat + ODD[1]))
    return flat, bounds, mix(sums + sizes.astype(np.uint64) * ODD[2])


def sketch(x: np.ndarray) -> bytes | None:
    """Numbers of shingles in about half as many ranges of the hash."""
    bits = max(0, (len(x) - 1).bit_length() - 1)
    counts = np.bincount((x >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) if bits else np.array([len(x)])
    if counts.max(initial=0) > 65535:
        return None
    return counts.astype("u1" if counts.max(initial=0) < 256 else "<u2").tobytes()


def counts_of(data: bytes, n: int) -> np.ndarray:
    """The numbers of a sketch of a set of ``n`` shingles."""
    ranges = 1 << max(0, (n - 1).bit_length() - 1)
    return np.frombuffer(data, "u1" if len(data) == ranges else "<u2").astype(np.int32)


def apart_by(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the number of shingles that only one of two sets has, from their sketches."""
    few = min(len(x), len(y))
    return int(np.abs(x.reshape(few, -1).sum(axis=1) - y.reshape(few, -1).sum(axis=1)).sum())


def segment_count(band: int, starts: list[int]) -> int:
    return max(64, starts[band + 1] * 9 // 20)


def subset_keys(sums: np.ndarray, scheme: int) -> np.ndarray:
    return mix(sums + ODD[3:4] * np.uint64(scheme + 1))


def scheme_keys(x: np.ndarray, scheme: int, segments: int, errors: int) -> tuple[np.ndarray, int]:
    """The keys that a set is indexed under in one scheme, and how many of them it can do without, plus one (0: none)."""
    values = mix(x + ODD[0])
    segment = ((mix(x ^ ODD[4]) >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
    sums = np.zeros(segments, np.uint64)
    np.add.at(sums, segment, values)
    sizes = np.bincount(segment, minlength=segments)
    keys = subset_keys(sums[sizes > 0], scheme)
    if len(keys) > errors:
        return keys, len(keys) - errors
    # Too few segments: every subset less one shingle as well, so that a segment may hold one error.
    several = sizes[segment] > 1
    keys = np.concatenate([keys, subset_keys(sums[segment[several]] - values[several], scheme)])
    if np.minimum(sizes, 2).sum() <= errors:
        keys = np.append(keys, mix(ODD[2:3] + np.uint64(scheme)))
    return np.unique(keys), 0


def index_keys(x: np.ndarray, starts: list[int]) -> list[tuple[np.ndarray, int]]:
    """Keys of a set and what it can spare: in the scheme of its band, and in the one below if partners can lie there."""
    n = len(x)
    band = int(np.searchsorted(starts, n, "right")) - 1
    found = [scheme_keys(x, band, segment_count(band, starts), (n + n * 4 // 3) // 7)]
    if band and -(-3 * n // 4) < starts[band]:
        found.append(scheme_keys(x, band - 1, segment_count(band - 1, starts), (n + starts[band] - 1) // 7))
    return found


def set_rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """A row per document: ``doc_id``, ``text_hash``, ``n``, ``node``: the hash of its set, ``sketch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text_", SET_BYTES):
            flat, bounds, node = shingle_sets(part.column("text_"))
            sketches = [sketch(flat[a:b]) if a < b else None for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(np.diff(bounds)), pa.array(node.view(np.int64)), pa.array(sketches, pa.binary())],
                names=["doc_id", "text_hash", "n", "node", "sketch"],
            )

    source = docs.select(
        F.col(id_column).cast("long").alias("id_"), F.xxhash64(text_column).alias("hash_"), as_bytes(text_column).alias("text_")
    )
    return arrow_map(source, run, "doc_id long, text_hash long, n long, node long, sketch binary")


def key_rows(docs: DataFrame, text_column: str) -> DataFrame:
    """The index, once per set and task: ``key``, ``node``, and ``spare``: twice what the set can do without in the
    scheme, plus one in the scheme of the band below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, starts = set(), band_starts(1 << 31)
        for part in slices(batches, "text_", SET_BYTES):
            flat, bounds, node = shingle_sets(part.column("text_"))
            keys, nodes, spares = [], [], []
            for a, b, name in zip(bounds.tolist(), bounds[1:].tolist(), node.tolist()):
                if a < b and name not in seen:
                    if len(seen) < 1 << 18:
                        seen.add(name)
                    for lower, (found, spare) in enumerate(index_keys(flat[a:b], starts)):
                        keys.append(found)
                        nodes.append(np.full(len(found), name, np.uint64))
                        spares.append(np.full(len(found), 2 * spare + lower, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c).view(np.int64)) for c in (keys, nodes, spares)], names=["key", "node", "spare"]
                )

    return arrow_map(docs.select(as_bytes(text_column).alias("text_")), run, "key long, node long, spare long")


def filter_of(nodes: DataFrame) -> np.ndarray:
    """A bit per possible low part of a node's hash; the driver gets its 512 parts of 4 KB."""
    low = F.col("node").bitwiseAND((1 << FILTER_BITS) - 1)

    def fill(key, rows):
        bits = np.zeros(1 << 15, bool)
        bits[rows["low"].to_numpy() & 0x7FFF] = True
        import pandas as pd

        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(bits).tobytes()]})

    parts = nodes.select(low.alias("low")).distinct().withColumn("part", F.shiftright("low", 15))
    out = np.zeros((1 << FILTER_BITS - 15, 1 << 12), np.uint8)
    for row in parts.groupBy("part").applyInPandas(fill, "part long, bits binary").collect():
        out[row.part] = np.frombuffer(row.bits, np.uint8)
    return np.unpackbits(out.reshape(-1)).view(bool)


def sets_of(docs: DataFrame, nodes: DataFrame, text_column: str) -> DataFrame:
    """``node`` and its sorted shingles ``x`` (64-bit, in binary) of the given nodes."""
    wanted = docs.sparkSession.sparkContext.broadcast(np.packbits(filter_of(nodes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.unpackbits(wanted.value).view(bool), set()
        for part in slices(batches, "text_", SET_BYTES):
            flat, bounds, node = shingle_sets(part.column("text_"))
            names, sets = [], []
            for i in np.flatnonzero(bits[node & np.uint64((1 << FILTER_BITS) - 1)] & (np.diff(bounds) > 0)).tolist():
                name = int(node[i].view(np.int64))
                if name not in seen:
                    if len(seen) < 1 << 18:
                        seen.add(name)
                    names.append(name)
                    sets.append(flat[bounds[i] : bounds[i + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], names=["node", "x"])

    found = arrow_map(docs.select(as_bytes(text_column).alias("text_")), run, "node long, x binary")
    return found.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "y"):
            good = []
            for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (len(both) - common))
            yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    full = pairs.join(sets.select(F.col("node").alias("a"), "x"), "a").join(
        sets.select(F.col("node").alias("b"), F.col("x").alias("y")), "b"
    )
    return arrow_map(full.select("a", "b", "x", "y"), run, "a long, b long")


def sifted(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose sketches do not rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [
                x is None or y is None or 7 * apart_by(counts_of(x, n), counts_of(y, m)) <= n + m
                for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "n", "m")))
            ]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    full = pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("x"), "n"), "a").join(
        sketches.select(F.col("node").alias("b"), F.col("sketch").alias("y"), F.col("n").alias("m")), "b"
    )
    return arrow_map(full.select("a", "b", "x", "y", "n", "m"), run, "a long, b long")


def block_pairs(rows: pa.Table, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of two blocks (or of one) that lie in different components and that sketches do not rule out."""
    n, label, block = (rows.column(c).to_numpy() for c in ("n", "label", "block"))
    sketches = [None if x is None else counts_of(x, m) for x, m in zip(rows.column("sketch").to_pylist(), n.tolist())]
    ranges = np.array([0 if x is None else len(x) for x in sketches])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    left = np.flatnonzero(block == low)
    for size in np.unique(ranges[left]).tolist():
        ours = left[ranges[left] == size]
        for other in (np.unique(ranges).tolist() if not size else (0, size // 2, size, size * 2)):
            theirs = np.flatnonzero((block == high) & (ranges == other))
            if not len(theirs):
                continue
            few = min(size, other)
            level = [None if not few else np.stack([sketches[i].reshape(few, -1).sum(axis=1) for i in at]) for at in (ours, theirs)]
            for k, i in enumerate(ours.tolist()):
                good = (label[theirs] != label[i]) & (3 * np.maximum(n[theirs], n[i]) <= 4 * np.minimum(n[theirs], n[i]))
                if low == high:
                    good &= theirs > i
                if few and good.any():
                    at = np.flatnonzero(good)
                    good[at] = 7 * np.abs(level[1][at] - level[0][k]).sum(axis=1) <= n[theirs[at]] + n[i]
                found.append((np.full(int(good.sum()), i), theirs[good]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found))


UNIT = ["cluster", "low", "high"]


def cluster_pairs(members: DataFrame) -> DataFrame:
    """All pairs (``a``, ``b``) of a cluster's sets (``node``, ``label``, ``n``, ``sketch``) that need an exact look."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"), F.min("label").alias("one"), F.max("label").alias("other"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    spread = sizes.where("one <> other").select("cluster", blocks.alias("blocks"))
    placed = members.join(spread, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    units = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cluster", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"),
        "node", "label", "n", "sketch", "block",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def close() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            node = rows.column("node").to_numpy()
            a, b = block_pairs(rows, key[1], key[2])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], names=["a", "b"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in UNIT])
            starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
                now = tuple(keys[:, a].tolist())
                if held and now != key:
                    yield close()
                    held = []
                key = now
                held.append(batch.slice(a, b - a))
        if held:
            yield close()

    return arrow_map(units.repartition(*UNIT).sortWithinPartitions(*UNIT, "node"), run, "a long, b long")


class Verifier:
    """Exact comparison of pairs; the sets it needs are taken from the texts once and stored."""

    def __init__(self, docs: DataFrame, rows: DataFrame, nodes: DataFrame, text_column: str, percent: int):
        self.docs, self.text_column, self.percent = docs, text_column, percent
        some = rows.where("n > 0").select("node", "n", "sketch").join(nodes, "node", "left_semi")
        self.sketches = stored(some.dropDuplicates(["node"]), "sketches")
        self.sets: DataFrame | None = None

    def possible(self, pairs: DataFrame) -> DataFrame:
        return stored(sifted(pairs, self.sketches), "possible")

    def fetch(self, pairs: DataFrame) -> None:
        """Take the sets of the pairs from the texts, as far as they are not at hand."""
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        if self.sets is not None:
            nodes = nodes.join(self.sets.select("node"), "node", "left_anti")
        nodes = stored(nodes, "nodes")
        if not nodes.isEmpty():
            more = stored(sets_of(self.docs, nodes, self.text_column), "sets")
            self.sets = more if self.sets is None else self.sets.unionByName(more)

    def links(self, pairs: DataFrame) -> DataFrame:
        """The links among pairs that ``possible`` has returned."""
        self.fetch(pairs)
        if self.sets is None:
            return pairs
        return stored(verify(pairs, self.sets, self.percent), "links")


def between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    ends = labels.select(F.col("node").alias("a"), F.col("label").alias("label_a"))
    others = labels.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
    found = pairs.join(ends, "a", "left").join(others, "b", "left")
    return found.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")


def link_components(docs: DataFrame, rows: DataFrame, percent: int, text_column: str) -> DataFrame:
    """``node`` and ``label`` for every set that links with a different one."""
    in_key = Window.partitionBy("key").orderBy("node")
    following = F.col("following")
    # Every set of a key that several sets share, once.
    met = stored(
        key_rows(docs, text_column).select(
            "key", "node", "spare", F.lead("node").over(in_key).alias("following"), F.dense_rank().over(in_key).alias("nth"),
        ).where((following.isNull() & (F.col("nth") > 1)) | (following != F.col("node"))).drop("following"),
        "met",
    )
    sized = stored(met.withColumn("sets", F.max("nth").over(Window.partitionBy("key"))).drop("nth"), "sized")
    drop_stored(met)
    cool = sized.where(F.col("sets") <= HOT).select("key", "node")
    pairs = cool.withColumnRenamed("node", "a").join(cool.withColumnRenamed("node", "b"), "key").where("a < b").select("a", "b")
    warm = sized.where(F.col("sets") > HOT).withColumn("lower", F.col("spare") % 2)
    bare = warm.groupBy("node", "lower").agg(F.count("*").alias("hot_keys"), F.first("spare").alias("spare")).where(
        F.col("hot_keys") >= F.shiftright("spare", 1)
    )
    members = stored(warm.select("key", "node", "lower").join(bare.select("node", "lower"), ["node", "lower"], "left_semi").drop("lower"), "members")
    first = members.groupBy("key").agg(F.min("node").alias("a"))
    stars = members.withColumnRenamed("node", "b").join(first, "key").where("a < b").select("a", "b")
    looked = stored(pairs.unionByName(stars).distinct(), "pairs")
    nodes = looked.select(F.col("a").alias("node")).unionByName(looked.select(F.col("b").alias("node")))
    verifier = Verifier(docs, rows, nodes.unionByName(members.select("node")).distinct(), text_column, percent)
    possible = verifier.possible(looked)
    verifier.fetch(possible)
    # One partner per set first: most other pairs then lie within a component and need no look.
    best = stored(possible.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs")
    links = verifier.links(best)
    labels = stored(connected_components(links), "labels")
    links = links.unionByName(verifier.links(between(possible.join(best, ["a", "b"], "left_anti"), labels)))
    # What is left are sets in different components that only hot keys have in common.
    labels = stored(connected_components(links), "labels")
    clusters = connected_components(stars)
    bare_sets = members.select("node").distinct().join(clusters, "node").withColumnRenamed("label", "cluster")
    known = bare_sets.join(labels, "node", "left").join(verifier.sketches, "node")
    rest = known.select("cluster", "node", F.coalesce("label", "node").alias("label"), "n", "sketch")
    new = stored(cluster_pairs(rest).distinct().join(looked, ["a", "b"], "left_anti"), "pairs")
    return connected_components(links.unionByName(verifier.links(new)))


def near_duplicates(docs: DataFrame, percent: int = 75, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id`` (the least id that links reach), ``group``
    (a number of the component, null for empty sets) and ``text_hash``.

    A document without an id takes part in links and gets the least id of its component, if any has one.
    """
    if percent != 75:
        raise ValueError("bands and error bounds are those of 75 percent")
    rows = stored(set_rows(docs, id_column, text_column), "sets-by-document")
    documents = rows.select("doc_id", "text_hash", "n", "node")
    classes = documents.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("size"))
    labels = link_components(docs, rows, percent, text_column)
    grouped = classes.join(labels, "node", "left").where("size > 1 or label is not null").select(
        "node", "least", F.coalesce("label", "node").alias("label")
    )
    heads = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    named = stored(grouped.join(heads, "label").select("node", "label", "component_id"), "components")
    filled = documents.where("n > 0").join(named, "node", "left").withColumn("group", F.coalesce("label", "node"))
    empty = documents.where("n = 0").withColumns({"component_id": F.lit(None).cast("long"), "group": F.lit(None).cast("long")})
    columns = [
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "group", "text_hash",
    ]
    return filled.select(*columns).unionByName(empty.select(*columns))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents without near duplicates: of each group the one of least id stays (a null id last), of repeated
    rows one.  Documents with empty sets stay."""
    found = stored(near_duplicates(docs, id_column=id_column, text_column=text_column), "groups").where("group is not null")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    heads = found.groupBy("group").agg(F.min(order).alias("head"))
    rows = found.groupBy("group", "doc_id", "text_hash").agg(F.count("*").alias("times"))
    judged = rows.join(heads, "group").withColumn(
        "stays", F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash"))
    )
    judged = stored(judged.where("not stays or times > 1").select(
        F.col("doc_id").alias("id__"), F.col("text_hash").alias("hash__"), "stays"
    ), "dropped")

    def matches(some: DataFrame):
        return docs[id_column].cast("long").eqNullSafe(some["id__"]) & (F.xxhash64(docs[text_column]) == some["hash__"])

    # The list grows with the documents: one plan, a sorted join, for all sizes.
    judged = judged.hint("merge")
    kept = docs.join(judged, matches(judged), "left_anti")
    repeated = judged.where("stays")
    if not repeated.isEmpty():
        again = docs.join(repeated, matches(repeated), "left_semi")
        kept = kept.unionByName(again.dropDuplicates([id_column, text_column]))
    return kept


