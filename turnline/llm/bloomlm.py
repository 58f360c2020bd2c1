"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Words and pairs of words of the training texts are counted exactly, as 64-bit hashes.
A count c is quantised to the level 1 + floor(log2 c), and an n-gram is put into the
filter once per level up to its own; a reader probes level after level until one is
missing, and so learns the level, never too low and rarely too high.  The filter lies in
4,096 segments; an n-gram belongs to one, so each segment is counted and filled by one
task, from lists that every reading task has counted before.  A segment gets its bits
from the levels counted in it, so that a level that is not there is read with a chance
of ``FALSE`` whatever the corpus; every word and every pair is put in.  A filter of at most 2^``FILTER_BITS`` bits (128 MB) is broadcast; a
larger one stays in its segments, and what the texts ask is shuffled to them and back.

A word's probability is interpolated: w * pair / context + (1 - w * k) * p(word), with p(word) =
(count + 0.1) / (N + 0.1 (V + 1)), w = context / (context + kappa) and all counts read from
the filter.  A pair that occurs once counts 1 - D, where D = n1 / (n1 + 2 n2) (n1 and n2 are the
distinct pairs that occur once and twice); k = 1 - D n1 / (all pairs) is what the pairs keep of
their mass on average, and p(word) gets the rest.

The base score uses exact counts.  Those of the most frequent words (at most
``TABLE_WORDS``) are broadcast; all rarer words are joined by hash.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end per text.  Null texts
count as empty: their only token is the end.  Repeated rows count as often as they occur.
Without any training text every count is zero.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnline.llm.common import arrow_map, as_bytes, free_shuffles, hashed, release, slices, stored, words_of

#: Bits of the largest filter that is broadcast, and of segments (as powers of two); probes per level.
FILTER_BITS, SEGMENT_BITS, PROBES = 30, 12, 6
#: Chance that a level that is not in the filter is read.
FALSE = 0.01
#: Bytes of text that are scored at a time.
SCORED_BYTES = 4 << 20
#: Bytes of text whose n-grams are asked together, on average, where the filter is not broadcast.
ASKED_BYTES = 16 << 20
#: Words whose exact counts are broadcast at most (16 bytes each).
TABLE_WORDS = 1 << 20
#: Tokens that a task counts before it passes the lists on, and a list's expected length when they are merged.
HELD_TOKENS, LIST_LENGTH = 1 << 22, 1 << 18
END = np.uint64(0x1F0E3DAD99908345)
ADD = 0.1
ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Smoothing:
    pair_from: int = 1
    kappa: float = 4.0


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text closed by an end, and the number of tokens per text."""
    distinct, number, bounds = words_of(texts)
    counts = np.diff(bounds) + 1
    out = np.full(len(number) + len(counts), END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(counts) - 1] = False
    out[inner] = hashed(distinct, xxhash.xxh3_64_intdigest)[number]
    return out, counts


def pairs(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of neighbouring tokens within a text, and the places of their second tokens."""
    first = np.zeros(len(hashes), bool)
    first[np.cumsum(counts) - counts] = True
    at = np.flatnonzero(~first)
    return mix(mix(hashes[at - 1]) + hashes[at] * ODD), at


def level(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, 1 + np.floor(np.log2(np.maximum(counts, 1))), 0).astype(np.int64)


def value(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level."""
    return np.where(levels > 1, 1.5 * 2.0 ** (levels - 1) - 0.5, levels)


def positions(hashes: np.ndarray, level: int, probe: int, bits: np.ndarray | int) -> np.ndarray:
    """A bit within the segment of the hash, which has so many ``bits`` (below 2^32)."""
    turn = ((1 + probe) * 0xD6E8FEB86659FD93 + level * 0xA0761D6478BD642F) & (1 << 64) - 1
    return ((mix(hashes + np.uint64(turn)) >> np.uint64(32)) * np.asarray(bits, np.uint64) >> np.uint64(32)).astype(np.int64)


def segment_bytes(inserted: int) -> int:
    """Bytes of a segment that so many levels are put into."""
    return max(8, math.ceil(inserted * PROBES / -math.log(1 - FALSE ** (1 / PROBES)) / 8))


def segment_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SEGMENT_BITS)).astype(np.int64)


def fill(bits: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> None:
    """Put n-grams of one segment into its bits (a byte each here)."""
    levels = level(counts)
    for j in range(1, int(levels.max(initial=0)) + 1):
        hashes, levels = hashes[levels >= j], levels[levels >= j]
        for probe in range(PROBES):
            bits[positions(hashes, j, probe, len(bits))] = 1


def read_levels(filter_bytes: np.ndarray, hashes: np.ndarray, starts: np.ndarray | None = None, top: int = 64) -> np.ndarray:
    """Levels of n-grams by repeated membership probes, at most ``top``; ``starts`` are the bits where each segment begins
    (and the last one ends), all of one size if not given."""
    if starts is None:
        starts = np.arange((1 << SEGMENT_BITS) + 1) * (len(filter_bytes) * 8 >> SEGMENT_BITS)
    levels = np.zeros(len(hashes), np.int64)
    at, left, segment = np.arange(len(hashes)), hashes, segment_of(hashes)
    base, bits = starts[segment], np.diff(starts)[segment]
    for j in range(1, top + 1):
        for probe in range(PROBES):
            bit = base + positions(left, j, probe, bits)
            there = (filter_bytes[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)
            at, left, base, bits = at[there], left[there], base[there], bits[there]
        if not len(at):
            break
        levels[at] = j
    return levels


def count_lists(training: DataFrame, parts: int) -> DataFrame:
    """Counted n-grams of each task: ``kind`` (1 words, 2 pairs), ``segment``, ``part`` within it, hashes and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {1: [], 2: []}
        size = 0

        def close():
            for kind, arrays in held.items():
                found, counts = np.unique(np.concatenate(arrays), return_counts=True)
                lists = (found >> np.uint64(64 - SEGMENT_BITS - parts)).astype(np.int64)
                starts = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])[: len(found)]
                ends = np.r_[starts[1:], len(found)]
                # Most n-grams occur once: those carry no count.
                rows = {"kind": [], "list": [], "once": [], "hashes": [], "counts": []}
                for a, b in zip(starts.tolist(), ends.tolist()):
                    once = counts[a:b] == 1
                    rows["kind"].append(kind)
                    rows["list"].append(int(lists[a]))
                    rows["once"].append(found[a:b][once].tobytes())
                    rows["hashes"].append(found[a:b][~once].tobytes())
                    rows["counts"].append(counts[a:b][~once].astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["kind"], pa.int32()), pa.array(rows["list"], pa.int64()),
                     *[pa.array(rows[c], pa.binary()) for c in ("once", "hashes", "counts")]],
                    names=["kind", "list", "once", "hashes", "counts"],
                )

        for part in slices(batches, "text_"):
            hashes, counts = tokens(part.column("text_"))
            held[1].append(hashes)
            held[2].append(pairs(hashes, counts)[0])
            size += len(hashes)
            if size >= HELD_TOKENS:
                yield from close()
                held, size = {1: [], 2: []}, 0
        if size:
            yield from close()

    return arrow_map(training, run, "kind int, list long, once binary, hashes binary, counts binary")


def merged(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and summed counts of some lists."""
    once = [np.frombuffer(r[0], np.uint64) for r in rows]
    many = [np.frombuffer(r[1], np.uint64) for r in rows]
    counts = np.concatenate([np.ones(sum(map(len, once)), np.int64), *[np.frombuffer(r[2], "<i4") for r in rows]])
    hashes = np.concatenate(once + many)
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, np.int64)
    return hashes[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def segments(lists: DataFrame, parts: int, pair_from: int) -> DataFrame:
    """Per segment: its bits, in packed form, with the number of pairs that occur again (as hash), of all pairs (as
    count) and of distinct pairs that occur twice; and the exact counts of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        inserted: list[tuple[np.ndarray, np.ndarray]] = []
        key = None
        pairs_, again, twice = 0, 0, 0

        def close():
            nonlocal pairs_, again, twice
            hashes, counts = merged(held)
            if key[2] == 1:
                inserted.append((hashes, counts))
                yield word_rows(hashes, counts)
            else:
                inserted.append((hashes[counts >= pair_from], counts[counts >= pair_from]))
                pairs_, again = pairs_ + int(counts.sum()), again + int(counts[counts > 1].sum())
                twice += int((counts == 2).sum())

        def bit_row():
            nonlocal pairs_, again, twice
            hashes, counts = (np.concatenate(c) for c in zip(*inserted))
            bits = np.zeros(segment_bytes(int(level(counts).sum())) * 8, np.uint8)
            fill(bits, hashes, counts)
            inserted.clear()
            data = np.packbits(bits).tobytes()
            row = pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int64()), pa.array([data], pa.binary()), *[pa.array([n], pa.int64()) for n in (again, pairs_, twice)]],
                names=["segment", "bits", "hash", "count", "twice"],
            )
            pairs_, again, twice = 0, 0, 0
            return row

        def word_rows(hashes, counts):
            n = len(hashes)
            return pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(hashes.view(np.int64)), pa.array(counts), pa.nulls(n, pa.int64())],
                names=["segment", "bits", "hash", "count", "twice"],
            )

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("segment", "list", "kind", "once", "hashes", "counts")]
            for segment, part, kind, *lists_ in zip(*columns):
                now = (segment, part, kind)
                if now != key and held:
                    yield from close()
                    held = []
                    if segment != key[0]:
                        yield bit_row()
                key = now
                held.append(tuple(lists_))
        if held:
            yield from close()
            yield bit_row()

    dealt = lists.withColumn("segment", F.shiftright("list", parts)).repartition("segment").sortWithinPartitions("segment", "list", "kind")
    return arrow_map(dealt, run, "segment long, bits binary, hash long, count long, twice long")


@dataclass(frozen=True)
class Model:
    filter_bytes: np.ndarray | None  # None if too large to be sent
    starts: np.ndarray | None  # bits where segments begin
    top: int  # the largest level
    words: np.ndarray  # sorted hashes of frequent words
    counts: np.ndarray
    total: int  # N
    distinct: int  # V
    discount: float  # D, of a pair that occurs once
    kept: float  # k


def learn(training: DataFrame, smoothing: Smoothing = Smoothing()) -> tuple[Model, DataFrame, DataFrame]:
    """The model, the exact counts (``hash``, ``count``) of the words that it does not hold, and the filter (``segment``, ``bits``)."""
    characters = training.agg(F.sum(F.length("text_"))).first()[0] or 0
    parts = max(0, math.ceil(math.log2(max(characters, 1) / 4 / LIST_LENGTH)) - SEGMENT_BITS)
    built = stored(segments(count_lists(training, parts), parts, smoothing.pair_from), "segments")
    filled = built.where("bits is not null")
    total = filled.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (
        (F.col("count"), "pairs"), (F.col("hash"), "again"), (F.col("twice"), "twice"), (F.length("bits"), "bytes"))]).first()
    once = total.pairs - total.again
    discount = once / max(once + 2 * total.twice, 1)
    filter_bytes = starts = None
    if total.bytes * 8 <= 1 << FILTER_BITS:
        parts_ = [b"\0"] * (1 << SEGMENT_BITS)
        for row in filled.select("segment", "bits").toLocalIterator():
            parts_[row.segment] = bytes(row.bits)
        starts = np.cumsum([0, *map(len, parts_)]) * 8
        filter_bytes = np.frombuffer(b"".join(parts_), np.uint8)
    counts = built.where("bits is null").select("hash", "count")
    sizes = counts.groupBy(F.length(F.bin("count")).alias("digits")).agg(
        F.count("*").alias("words"), F.sum("count").alias("total")
    ).orderBy(F.desc("digits")).collect()
    held, floor = 0, 1 << 62
    for row in sizes:
        if held + row.words > TABLE_WORDS:
            break
        held, floor = held + row.words, 1 << row.digits - 1
    frequent = counts.where(F.col("count") >= floor).toArrow()
    words = frequent.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(words)
    # No pair occurs more often than its first word.
    model = Model(filter_bytes, starts, max((r.digits for r in sizes), default=0), words[order], frequent.column("count").to_numpy()[order],
                  sum(r.total for r in sizes), sum(r.words for r in sizes), discount, 1 - discount * once / max(total.pairs, 1))
    return model, counts.where(F.col("count") < floor), filled.select("segment", "bits")


def score_texts(
    texts: pa.Array, model: Model, smoothing: Smoothing, levels_of: Callable[[np.ndarray], np.ndarray],
    coded: tuple[np.ndarray, np.ndarray] | None = None,
) -> dict[str, np.ndarray | list]:
    """Per text: tokens, known ones and base score as far as the model's words go, the score, and its other words;
    ``levels_of`` reads the filter; ``coded`` are the ``tokens`` of the texts, if they are there."""
    hashes, counts = coded or tokens(texts)
    text = np.repeat(np.arange(len(texts)), counts)
    distinct, back = np.unique(hashes, return_inverse=True)
    norm = model.total + ADD * (model.distinct + 1)
    if len(model.words):
        place = np.minimum(np.searchsorted(model.words, distinct), len(model.words) - 1)
        exact = np.where(model.words[place] == distinct, model.counts[place], -1)[back]
    else:
        exact = np.full(len(hashes), -1)
    base = np.bincount(text, np.where(exact >= 0, np.log10((np.maximum(exact, 0) + ADD) / norm), 0.0), len(texts))
    single = value(levels_of(distinct))[back]
    probability = np.minimum((single + ADD) / norm, 1.0)
    pair, at = pairs(hashes, counts)
    context = single[at - 1]
    levels = levels_of(pair)
    seen = np.where(levels == 1, 1 - model.discount, np.minimum(value(levels), context))
    weight = context / (context + smoothing.kappa)
    probability[at] = np.minimum(weight * seen / np.maximum(context, 1) + (1 - weight * model.kept) * probability[at], 1.0)
    other = np.flatnonzero(exact < 0)
    order = other[np.lexsort((hashes[other], text[other]))]
    h, t = hashes[order], text[order]
    starts = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])]) if len(h) else np.zeros(0, np.int64)
    times = np.diff(np.r_[starts, len(h)])
    bounds = np.searchsorted(t[starts], np.arange(len(texts) + 1))
    return {
        "n_tokens": counts, "known": np.bincount(text, exact >= 0, len(texts)).astype(np.int64), "base": base,
        "score": np.bincount(text, np.log10(probability), len(texts)), "bounds": bounds,
        "hashes": h[starts].view(np.int64), "times": times,
    }


def asked_of(coded: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The distinct n-grams of some texts (hashes and counts of their tokens), sorted, and so by segment."""
    return distinct_of([np.zeros(0, np.uint64), *(distinct_of([h, pairs(h, counts)[0]]) for h, counts in coded)])


def distinct_of(arrays: list[np.ndarray]) -> np.ndarray:
    """Sorted; ``np.unique`` would put them into a hash table first, which takes several times as long."""
    found = np.sort(np.concatenate(arrays))
    return found[np.r_[True, found[1:] != found[:-1]][: len(found)]]


def answers_of(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """The levels (``data``, a byte each) of every list of n-grams (``slice``, ``segment``, ``data``); the bits of a segment
    come before its lists, in a row without a slice.  The lists of a segment that are in a batch are read at once."""
    now, bits, starts = None, None, None
    for batch in batches:
        segment, given = batch.column("segment").to_numpy(), batch.column("slice").is_null().to_numpy(zero_copy_only=False)
        size = pc.binary_length(batch.column("data")).to_numpy()
        for a, b in runs(segment):
            if given[a]:
                now, bits = segment[a], np.frombuffer(batch.column("data")[a].as_py(), np.uint8)
                starts = np.where(np.arange((1 << SEGMENT_BITS) + 1) > now, len(bits) * 8, 0)
                a += 1
            if a == b:
                continue
            hashes = np.frombuffer(b"".join(batch.column("data").slice(a, b - a).to_pylist()), np.uint64)
            levels = read_levels(bits, hashes, starts, top) if now == segment[a] else np.zeros(len(hashes))
            ends = np.r_[0, np.cumsum(size[a:b] // 8)].astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends), pa.py_buffer(levels.astype(np.uint8))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("slice").slice(a, b - a), batch.column("segment").slice(a, b - a), data], names=["slice", "segment", "data"],
            )


def runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal keys begin and end."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[: len(keys)].tolist()
    return list(zip(starts, [*starts[1:], len(keys)]))


def answered(
    docs: DataFrame, filled: DataFrame, top: int, scored: Callable[[pa.RecordBatch, tuple, Callable[[np.ndarray], np.ndarray]], pa.RecordBatch],
    schema: str,
) -> DataFrame:
    """The rows ``scored``, where the filter stays in its segments: rows are dealt out in slices, by their content; a
    slice sends every segment the distinct n-grams that it asks and gets back their levels, in order.

    Texts are shuffled once, for the asking and the scoring: a slice's n-grams follow from its rows in any order, and are
    worked out again instead of being kept.
    """
    size = docs.agg(F.sum(F.length("text_"))).first()[0] or 0
    n = size // ASKED_BYTES + 1
    by_content = F.pmod(F.xxhash64("id", "text_"), F.lit(n)).cast("long")
    sliced = docs.select(by_content.alias("slice"), "id", "held_out", "text_").repartition(n, "slice")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        key = None

        def close():
            asked = distinct_of(held)
            segment = segment_of(asked)
            cuts = runs(segment)
            for some in range(0, len(cuts), 512):
                some = cuts[some:some + 512]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), key)), pa.array(segment[[a for a, _ in some]]),
                     pa.array([asked[a:b].tobytes() for a, b in some], pa.binary())], names=["slice", "segment", "data"],
                )

        for batch in batches:
            for a, b in runs(batch.column("slice").to_numpy()):
                if key != (now := batch.column("slice")[a].as_py()):
                    if held:
                        yield from close()
                    held, key = [], now
                held += [asked_of([tokens(part.column("text_"))]) for part in slices(iter([batch.slice(a, b - a)]), "text_")]
        if held:
            yield from close()

    def score_slice(rows: pa.Table, answers: pa.Table) -> pa.Table:
        parts = list(slices(iter(rows.combine_chunks().to_batches()), "text_", SCORED_BYTES))
        coded = [tokens(part.column("text_")) for part in parts]
        asked = asked_of(coded)
        levels = answers.sort_by("segment").column("data").to_pylist()
        read_ = np.frombuffer(b"".join(levels), np.uint8).astype(np.int64)
        if len(read_) != len(asked):
            raise RuntimeError(f"{len(asked)} n-grams were asked and {len(read_)} answered")

        def levels_of(hashes: np.ndarray) -> np.ndarray:
            order, found = np.argsort(hashes), np.empty(len(hashes), np.int64)
            found[order] = read_[np.searchsorted(asked, hashes[order])]  # many times as fast as in their own order
            return found

        out = [scored(part, code, levels_of) for part, code in zip(parts, coded)]
        release()
        return pa.Table.from_batches(out)

    questions = arrow_map(sliced.sortWithinPartitions("slice"), ask, "slice long, segment long, data binary")
    bits = filled.select(F.lit(None).cast("long").alias("slice"), "segment", F.col("bits").alias("data"))
    dealt = bits.unionByName(questions).repartition("segment").sortWithinPartitions("segment", F.asc_nulls_first("slice"))
    answers = arrow_map(dealt, lambda batches: answers_of(batches, top), "slice long, segment long, data binary")
    return sliced.groupBy("slice").cogroup(answers.repartition(n, "slice").groupBy("slice")).applyInArrow(score_slice, schema)


def score(docs: DataFrame, in_training: Column, smoothing: Smoothing = Smoothing(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id column, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row."""
    spark = docs.sparkSession
    trained = F.coalesce(in_training, F.lit(False))
    model, rare, filled = learn(docs.where(trained).select(as_bytes(text_column).alias("text_")), smoothing)
    shared = spark.sparkContext.broadcast(model)  # 128 MB of filter at most, and 16 bytes for each of TABLE_WORDS words

    def scored(part: pa.RecordBatch, coded: tuple | None, levels_of: Callable[[np.ndarray], np.ndarray]) -> pa.RecordBatch:
        r = score_texts(part.column("text_"), shared.value, smoothing, levels_of, coded)
        lists = [pa.ListArray.from_arrays(pa.array(r["bounds"].astype(np.int32)), pa.array(r[c])) for c in ("hashes", "times")]
        return pa.RecordBatch.from_arrays(
            [part.column("id"), part.column("held_out"), *[pa.array(r[c]) for c in ("n_tokens", "known", "base", "score")], *lists],
            names=["id", "held_out", "n_tokens", "known", "base", "score", "hashes", "times"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text_", SCORED_BYTES):
            held = shared.value
            yield scored(part, None, lambda hashes: read_levels(held.filter_bytes, hashes, held.starts, held.top))

    id_type = docs.schema[id_column].dataType.simpleString()
    read_from = docs.select(F.col(id_column).alias("id"), (~trained).alias("held_out"), as_bytes(text_column).alias("text_"))
    schema = f"id {id_type}, held_out boolean, n_tokens long, known long, base double, score double, hashes array<long>, times array<long>"
    if model.filter_bytes is not None:
        levelled = arrow_map(read_from, run, schema)
    else:
        free_shuffles(spark)
        levelled = answered(read_from, filled, model.top, scored, schema)
    rows = stored(levelled.withColumn("row", F.monotonically_increasing_id()), "scored")
    del levelled
    free_shuffles(spark)
    norm = model.total + ADD * (model.distinct + 1)
    open_words = rows.select("row", F.explode(F.arrays_zip("hashes", "times")).alias("w")).select(
        "row", F.col("w.hashes").alias("hash"), F.col("w.times").alias("times")
    )
    counted = open_words.join(rare, "hash", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    rest = counted.groupBy("row").agg(
        F.sum(F.col("times") * F.log10((F.col("count") + ADD) / F.lit(norm))).alias("base_"),
        F.sum(F.when(F.col("count") > 0, F.col("times")).otherwise(0)).alias("known_"),
    )
    zero = F.lit(0)
    return rows.join(rest, "row", "left").select(
        F.col("id").alias(id_column), "held_out", "n_tokens", (F.col("known") + F.coalesce("known_", zero)).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("base_", F.lit(0.0))).alias("base_score"), "score",
    )
