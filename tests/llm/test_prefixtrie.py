"""The conversation trie against plain Python."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from turnline.llm import prefixtrie

WIDE = "text string, conv_id long, role string, turn long, path string, head long, key string, shard int, words int, skeleton int"


def nodes_of(rows, group=20):
    """Nodes by definition, from (conv_id, turn, role, text)."""
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0), role or "", text or ""))
    turns = {c: [(r, x) for _, r, x in sorted(found, key=lambda y: y[:2])] for c, found in turns.items()}
    convs = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4 if group else 0
        convs[c] = turns.get(c - c % group, [])[:h] + own[h:] if group else own
    members, children = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[x] for x in children[node])
    return sorted((
        (m[0], len(node), members[node[:-1]][0] if node else None, len(m), len(children[node]), leaves[node], saved[node],
         hashlib.sha256(",".join(str(c) for c in m if len(convs[c]) == len(node)).encode()).hexdigest())
        for node, m in members.items()), key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.fixture(scope="module")
def hard():
    """Shared beginnings, equal conversations, one very long, empty and null turns, repeated rows, absent heads."""
    rows = []
    for c in range(120):
        if c % 40 != 20:  # some groups have no head
            rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"w{(c * 7 + t) % 3} x{t}") for t in range(c % 6)]
    rows += [(c, t, "user", "same same same") for c in range(200, 9000, 3) for t in range(2)]
    rows += [(9001, t, "user", f"long {t}") for t in range(700)] + [(9002, t, "user", f"long {t}") for t in range(650)]
    rows += [(9100, None, None, None), (9100, 0, "user", ""), (9100, 0, "user", ""), (9101, None, "", ""), (9101, 5, "user", None)]
    rows += [(None, 0, "user", "nobody"), (9102, 1, "user", "v " * 200_000), (9103, 1, "user", "v " * 200_000 + "w")]
    return rows


@pytest.mark.parametrize("group", [20, None])
@pytest.mark.parametrize("shard_bytes,skeleton_bytes", [(1 << 20, 1 << 20), (2000, 1 << 20), (60, 1 << 20), (60, 4000)])
def test_trie_is_the_plain_one(spark, hard, group, shard_bytes, skeleton_bytes):
    frame = spark.createDataFrame(hard, "conv_id long, turn long, role string, text string").repartition(5)
    trie = prefixtrie.prefix_trie(prefixtrie.paths_of(frame, group), shard_bytes=shard_bytes, skeleton_bytes=skeleton_bytes)
    assert trie.columns == prefixtrie.COLUMNS
    assert found(trie) == nodes_of(hard, group)


def test_splitters_cut_evenly_and_no_longer_than_needed(spark, hard):
    frame = spark.createDataFrame(hard, "conv_id long, turn long, role string, text string")
    known = prefixtrie.distinct_paths(prefixtrie.paths_of(frame))
    assert known.where("n > 1000").count() == 1  # the equal conversations are one row
    splitters = prefixtrie.splitters_of(known, 40, 1000, 1 << 20)
    assert len(splitters) > 3 and splitters == sorted(set(splitters)) and all(len(s) % prefixtrie.TURN == 0 for s in splitters)
    assert prefixtrie.splitters_of(known, 1 << 30, 1000, 1 << 20) == []
    skeleton = prefixtrie.Skeleton(splitters)
    assert len(skeleton.parents) == len({s[:i] for s in splitters for i in range(0, len(s) + 1, prefixtrie.TURN)})
    for row in known.collect():
        path = bytes(row.path)
        shard = skeleton.shard_of(path)
        assert (not shard or splitters[shard - 1] <= path) and (shard == len(splitters) or path < splitters[shard])


def test_empty_single_and_clashing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefixtrie.prefix_trie(prefixtrie.paths_of(empty, 20)).count() == 0
    rows = [(3, 0, "user", "a b"), (3, 1, "user", "c"), (4, 0, "user", "a b")]
    wide = spark.createDataFrame([(x, c, r, t, "p", 1, "k", 2, 3, 4) for c, t, r, x in rows], WIDE)
    assert found(prefixtrie.prefix_trie(prefixtrie.paths_of(wide, 20), shard_bytes=1)) == nodes_of(rows)
