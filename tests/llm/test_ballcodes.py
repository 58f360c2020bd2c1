"""Ball k-means against the plain method."""

import hashlib

import numpy as np
import pytest

from turnline.llm import ballcodes

NAN, INF = float("nan"), float("inf")


def plain(rows, parts=16, entries=64, rounds=2, scale=256):
    """Codes and errors by id, label errors, and the codebook digest, of vectors of one length."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, [int(np.floor(scale * c)) for c in r[1]]))
    x = np.floor(np.array([r[1] for r in rows], np.float64) * scale).astype(np.int64).reshape(len(rows), parts, -1)
    book = x[:entries].transpose(1, 0, 2).copy()

    def nearest():
        return np.stack([((x[:, p][:, None] - book[p]) ** 2).sum(-1).argmin(axis=1) for p in range(parts)], axis=1)

    for _ in range(rounds):
        codes = nearest()
        for p in range(parts):
            for e in range(book.shape[1]):
                own = x[codes[:, p] == e, p]
                if len(own):
                    book[p, e] = own.sum(axis=0) // len(own)
    codes = nearest()
    errors = sum(((x[:, p] - book[p][codes[:, p]]) ** 2).sum(-1) for p in range(parts)).tolist()
    labels = {}
    for row, error in zip(rows, errors):
        labels[row[2]] = labels.get(row[2], 0) + error
    digest = hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()
    return sorted(((r[0], bytes(c.astype(np.uint8)).hex(), e, labels[r[2]], digest) for r, c, e in zip(rows, codes, errors)), key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def clustered(rng, n, width):
    centres = rng.normal(0, 1, (40, width))
    return (centres[rng.integers(0, 40, n)] + rng.normal(0, 0.2, (n, width))).astype(np.float32).astype(float)


@pytest.mark.parametrize("kind", ["clustered", "even", "ties"])
def test_codes_are_those_of_the_plain_method(spark, kind):
    rng = np.random.default_rng(12)
    if kind == "clustered":
        v = clustered(rng, 1500, 32)
    elif kind == "even":
        v = rng.normal(0, 0.5, (800, 64))
    else:  # few different whole numbers: many equal distances and repeated entries
        v = rng.integers(-2, 3, (900, 32)) / 256
    rows = [(int(i) - 50, x.tolist(), None if i % 7 == 0 else int(i % 3)) for i, x in enumerate(v)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(7)
    assert found(ballcodes.code_rows(*ballcodes.compress(frame))) == plain(rows)


def test_balls_skip_work_and_change_nothing():
    rng = np.random.default_rng(3)
    x = np.floor(clustered(rng, 4000, 32) * 256).astype(np.int64).reshape(-1, 8, 4)
    book = x[:64].transpose(1, 0, 2).copy()
    codes = ballcodes.nearest_of_all(x, book)
    far = ballcodes.squared(x, book[np.arange(8), codes])
    radii = np.zeros((8, 64), np.int64)
    for p in range(8):
        np.maximum.at(radii[p], codes[:, p], np.ceil(np.sqrt(far[:, p])).astype(np.int64) + 1)
    after = book + rng.integers(-3, 4, book.shape)
    way = np.ceil(np.sqrt(ballcodes.squared(after, book))).astype(np.int64) + 1
    new, looked = ballcodes.Balls(after, radii + way).nearest(x, codes)
    assert (new == ballcodes.nearest_of_all(x, after)).all()
    assert looked < 0.5 * x.shape[0] * 8 * 63  # of the distances to all other entries


def test_hard_rows_lengths_and_clashing_columns(spark):
    rng = np.random.default_rng(5)
    good = [(int(i), rng.normal(0, 1, 16).tolist(), "n") for i in range(30)] + [(99, [0.0] * 16, "n"), (99, [0.0] * 16, "n")]
    good += [(None, rng.normal(0, 1, 16).tolist(), None)]
    other = [(500 + i, rng.normal(0, 1, 48).tolist(), None) for i in range(80)]
    bad = [(200, None, "n"), (201, [NAN] * 16, "n"), (202, [INF] * 16, "n"), (203, [None] * 16, "n"), (204, [], "n"), (205, [1.0] * 15, "n")]
    rows = [(e, "c", i, 1, 2.0, "x", l) for i, e, l in good + other + bad]
    frame = spark.createDataFrame(rows, "embedding array<double>, codes string, vec_id long, dimension int, error double, x string, label string")
    got = {r.vec_id: tuple(r) for r in ballcodes.code_rows(*ballcodes.compress(frame)).collect()}
    assert len(got) == 32 + 80 and got[None][0] is None
    for some in (good, other):
        label = {}  # label errors run over all lengths; the rest is by length
        for row in plain(some):
            assert got[row[0]][:3] == row[:3] and got[row[0]][4] == row[4]
    errors = [(r[2], l) for i, _, l in good + other for r in [got[i]]]
    label = {l: sum(e for e, m in errors if m == l) for l in (None, "n")}
    assert all(got[i][3] == label[l] for i, _, l in good + other)
    assert ballcodes.code_rows(*ballcodes.compress(frame.limit(0))).count() == 0


def test_labels_beyond_the_bound_are_joined_by_shuffle(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 1, 16).tolist(), None if i % 5 == 0 else i % 4) for i in range(100)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(ballcodes, "MAX_LABELS", 2)
    assert found(ballcodes.code_rows(*ballcodes.compress(frame))) == plain(rows)


def test_decoded_vectors_are_near(spark):
    rng = np.random.default_rng(7)
    v = clustered(rng, 600, 32)
    frame = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    coded, books = ballcodes.compress(frame)
    back = {r.vec_id: ballcodes.decode(bytes(r.codes), books[32]) for r in coded.collect()}
    off = np.mean([((back[i] - x) ** 2).sum() for i, x in enumerate(v)])
    assert off < 0.1 * np.mean((v**2).sum(axis=1))
