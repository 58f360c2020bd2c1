"""Vector operators against brute force."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from turnline.llm import graph, simhash
from turnline.llm.common import read
from turnline.llm.queries import queries

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def hard(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((6, 8))
    rows = [(i, [float(x) for x in base[i % 6] + rng.normal(0, 0.05 * (i % 3), 8)], "n") for i in range(60)]
    rows += [(100 + i, [float(x) for x in base[0]], "n") for i in range(40)]
    rows += [(200, None, "n"), (201, [0.0] * 8, "n"), (202, [NAN] * 8, "n"), (203, [INF] * 8, "n"), (204, [None] * 8, "n"),
             (None, [1.0] * 8, "n"), (205, [1.0, 2.0], "n"), (205, [1.0, 2.0], "n")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, node string")


def valid(frame):
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in frame.collect()
            if r.vec_id is not None and r.embedding is not None and None not in r.embedding]
    return [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]


def linked(vectors):
    out = {}
    for k, (i, v) in enumerate(vectors):
        for j, w in vectors[:k]:
            if len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.9:
                out.setdefault(i, []).append(j)
                out.setdefault(j, []).append(i)
    return out


def components(ids, links):
    label = {i: i for i in ids}
    while True:
        new = {i: min([label[i], *(label[j] for j in links.get(i, []))]) for i in ids}
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("block", [4, 1024])
def test_near_vectors_of_hard_rows(spark, hard, block):
    rows = simhash.near_vectors(hard, recall=0.9999, block=block).collect()
    assert len(rows) == hard.count()
    links = linked(valid(hard))
    label = components([r.vec_id for r in rows if r.vec_id is not None], links)
    for r in rows:
        n = 1 if r.vec_id == 205 else len(links.get(r.vec_id, []))  # two rows of the same id
        assert r.n_links == n and r.component_id == (label[r.vec_id] if r.vec_id is not None else None)
        assert r.kept == (r.vec_id is not None and r.vec_id == r.component_id)
    assert simhash.near_vectors(hard.limit(0)).count() == 0


def test_near_vectors_recall(spark, data_dir):
    frame = read(spark, data_dir, "embeddings")
    links = linked(valid(frame))
    found = {r.vec_id: r.n_links for r in queries()["op5_vector_near_dedup"](spark, data_dir).collect()}
    assert all(n <= len(links.get(i, [])) for i, n in found.items())
    assert sum(found.values()) >= 0.95 * sum(map(len, links.values()))


def test_pairs_at_the_threshold_are_found(spark):
    """The chance that a pair is missed is largest at the threshold; in 64 dimensions only the two of a pair are near."""
    rng = np.random.default_rng(8)
    v, w = rng.standard_normal((2, 3000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    w -= (v * w).sum(axis=1)[:, None] * v
    w *= np.sqrt(1 - 0.9001**2) / np.linalg.norm(w, axis=1)[:, None]
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate([v, 0.9001 * v + w]))]
    found = simhash.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert found.where("n_links = 1").count() >= 0.995 * 6000


def shuffled(spark):
    """Bytes that each stage so far has written to shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_near_vectors_shuffle_few_copies(spark, monkeypatch):
    """However many tables there are, some are dealt out at a time, and a vector travels as its bytes."""
    monkeypatch.setattr(simhash, "ROUND_BYTES", 0, raising=False)  # two tables at a time
    v = np.random.default_rng(9).standard_normal((4000, 64))
    v[1::4] = v[::4] + 0.01
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(4)
    before = shuffled(spark)
    rows = simhash.near_vectors(frame).collect()
    written = [n for k, n in shuffled(spark).items() if k not in before]
    assert sum(r.n_links == 1 for r in rows) == 2000
    assert max(written) < 1.3 * 2 * 4000 * 64 * 4
    assert sum(written) < 16 * 4000 * 64 * 4


@pytest.mark.parametrize("block", [1 << 17, 40])
def test_near_vectors_in_fine_tables(spark, monkeypatch, block):
    """Two levels of tables, as for many vectors: every link counts once, and none is missed where recall asks for all."""
    for name, value in (("UNIT_VECTORS", 150), ("FINE_BUCKET", 20), ("FINE_TABLES", 3)):
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(11)
    v = rng.standard_normal((300, 24))
    v = np.concatenate([v, v[:200] + rng.normal(0, 0.2, (200, 24)), v[:1] + rng.normal(0, 0.25, (150, 24)), v[:40]])
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    by = simhash.shape(650, 0.9, 1 - 1e-9, 7)
    assert by.fine_tables == 3 and by.fine_bits > 1 and by.tables > 4
    rows = simhash.near_vectors(frame, recall=1 - 1e-9, block=block).collect()
    links = linked(list(enumerate(v)))
    label = components(range(len(v)), links)
    assert {r.vec_id: (r.n_links, r.component_id) for r in rows} == {i: (len(links.get(i, [])), label[i]) for i in range(len(v))}


def test_large_buckets_are_found(spark):
    """Those of more than a block, with as many blocks as they need, though no task counts a code that is rare in it."""
    rng = np.random.default_rng(5)
    rows = [(i, (np.eye(1, 16)[0] * 9 + rng.standard_normal(16) if i % 2 else rng.standard_normal(16)).tolist()) for i in range(3000)]
    frame = spark.createDataFrame(rows, "node long, vector array<float>").selectExpr("node", "1L size", "node least", "vector").repartition(5)
    nodes, by = simhash.packed(frame, "<f4"), simhash.Shape(5, 3, 2, 4, seed=7)
    v = np.array([x for _, x in rows], "<f4")
    codes = simhash.codes_of(v, 0, 3, by)[:, :, 0]
    assert (simhash.codes_of(v, 0, 3, by, fine=True)[::-1] == simhash.codes_of(v[::-1], 0, 3, by, fine=True)).all()
    assert (codes[:, 1:2] == simhash.codes_of(v, 1, 2, by, fine=True)[:, :, 0]).all()
    for block in (50, 400):
        large = simhash.large_buckets(nodes, "<f4", by, block)
        for t in range(3):
            found = dict(zip(*(x.tolist() for x in large.get((t, 16), ((np.zeros(0),) * 2)))))
            for code, n in zip(*np.unique(codes[:, t], return_counts=True)):
                assert found.get(code, 1) >= n / block


def exact(vectors, query, k):
    i, v = query
    others = [(float(np.dot(w, v)), j) for j, w in vectors if j != i]
    return sorted(others, key=lambda x: (-x[0], x[1]))[:k]


def test_neighbours_recall_and_scores(spark):
    data_dir = "/root/testdata/sf0.1"
    vectors = valid(read(spark, data_dir, "embeddings"))
    found = {}
    for r in queries()["op3_graph_neighbours"](spark, data_dir).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    asked = [x for x in vectors if x[0] % 20 == 0]
    assert set(found) == {i for i, _ in asked}
    by_id, hits = dict(vectors), 0
    for i, v in asked:
        rows = sorted(found[i])
        assert [r for r, _, _ in rows] == list(range(1, 21))
        assert all(abs(s - by_id[j] @ v) < 1e-12 for _, j, s in rows)
        hits += len({j for _, j in exact(vectors, (i, v), 20)} & {j for _, j, _ in rows})
    assert hits >= 0.9 * 20 * len(asked)


def test_neighbours_of_hard_rows(spark, hard):
    rows = graph.nearest(hard, F.col("id") % 20 == 0, k=5, shard=40).collect()
    vectors = [x for x in valid(hard) if len(x[1]) == 8]
    for i, v in [x for x in vectors if x[0] % 20 == 0]:
        mine = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == i)
        assert [round(s, 5) for _, _, s in mine] == [round(s, 5) for s, _ in exact(vectors, (i, v), 5)]
    copies = sorted((r.rank, r.vec_id) for r in rows if r.query_id == 100)
    assert [j for _, j in copies][:3] != [100, 100, 100] and 100 not in [j for _, j in copies]
    assert graph.nearest(hard.limit(0), F.col("id") % 20 == 0).count() == 0


def test_neighbours_of_mixed_lengths(spark):
    """A stray vector in front drops nobody; every length is searched by itself."""
    rng = np.random.default_rng(6)
    rows = [(1, [1.0, 2.0])] + [(2 + i, rng.standard_normal(3 if i % 3 else 8).tolist()) for i in range(90)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    found = {}
    for r in graph.nearest(frame, F.col("id") % 10 < 2, k=5, shard=40).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for i, v in [x for x in rows if x[0] % 10 < 2 and x[0] > 1]:
        same = [(j, w) for j, w in rows if len(w) == len(v)]
        assert [j for _, j in sorted(found[i])] == [j for _, j in exact(same, (i, v), 5)]
    assert 1 not in found  # nothing else is as long


def made_vectors(kind, n, rng):
    """64 components, as float32 tables hold them."""
    v = rng.standard_normal((n, 64))
    if kind == "clustered":
        v = rng.standard_normal((200, 64))[rng.integers(0, 200, n)] + 0.3 * v
    if kind in ("unit", "clustered"):
        v /= np.linalg.norm(v, axis=1)[:, None]
    spread = {"clustered": 0.3, "uneven": 0.3, "very uneven": 0.7}.get(kind)
    if spread:
        v *= rng.lognormal(0, spread, n)[:, None]
    return v.astype(np.float32)


@pytest.mark.parametrize("kind", ["unit", "clustered", "gaussian", "uneven", "very uneven"])
def test_neighbours_recall_of_full_shards(spark, tmp_path, kind):
    """33,000 vectors of every kind of length: two full shards, or bands of like length."""
    v = made_vectors(kind, 33_000, np.random.default_rng(11))
    flat = pa.array(v.reshape(-1))
    table = pa.table({"vec_id": pa.array(np.arange(len(v))), "embedding": pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, 64, dtype=np.int32)), flat)})
    pq.write_table(table, tmp_path / "vectors.parquet", row_group_size=5000)
    found = {}
    for r in graph.nearest(spark.read.parquet(str(tmp_path / "vectors.parquet")), F.col("id") % 150 == 0, k=20).collect():
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    every, hits, total = v.astype(np.float64), 0, 0
    for i in range(0, len(v), 150):
        score = every @ every[i]
        score[i] = -INF
        best = np.argsort(-score, kind="stable")[:20]
        hits, total = hits + len(found[i].keys() & set(best.tolist())), total + 20
        assert len(found[i]) == 20 and all(abs(x - score[j]) < 1e-9 for j, x in found[i].items())
    print(f"{kind}: recall {hits / total:.4f}")
    assert hits >= 0.9 * total


def test_bands_share_shards_until_they_are_full():
    bands = [(64, 30, 5, 9.0), (64, 29, 300, 8.0), (64, 10, 40_000, 2.0), (64, 3, 9, 1.1), (2, 0, 3, 1.0)]
    plan = graph.joined_bands(bands, 16_384)
    assert [(d, b, first, shards, early) for d, b, first, shards, _, early in plan] == [
        (2, 0, 0, 1, True), (64, 30, 1, 1, True), (64, 29, 1, 1, True), (64, 10, 2, 3, True), (64, 3, 2, 3, True)]
    assert [longest for *_, longest, _ in plan] == [1.0, 9.0, 9.0, 2.0, 2.0]
    assert graph.joined_bands([], 100) == []
