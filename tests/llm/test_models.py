"""The trained operators against plain versions: FTRL, the mixing exponent, and the language model's score."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnline.llm import bloomlm, mixing, toxicity

M64 = (1 << 64) - 1


def plain_features(text, bits):
    """The distinct features of a text, by definition."""
    words = text.translate(str.maketrans({c: " " for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"})).split()
    h = [zlib.crc32(re.sub("[A-Z]", lambda m: m[0].lower(), w).encode()) for w in words]
    out = {x * 0x9E3779B97F4A7C15 & M64 for x in h}
    for gap, factor in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        for a, b in zip(h, h[gap:]):
            pair = a * factor + b * 0x27D4EB2F165667C5 + gap & M64
            out.add(pair * 0x9E3779B97F4A7C15 & M64)
    return {x >> 64 - bits for x in out}


def plain_ftrl(rows, alpha, beta, l1, l2):
    """FTRL-proximal over (features, label) rows with a bias, one coordinate at a time."""
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        if abs(zi) <= l1:
            return 0.0
        return -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for features, label in rows:
        at = [*features, "bias"]
        w = {i: weight(i) for i in at}
        p = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values())))))
        for i in at:
            g, was = p - label, n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / alpha * w[i]
            n[i] = was + g * g
    return {i: weight(i) for i in z if weight(i)}


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["Bad", "WORSE!"]
    rows = []
    for i in range(200):
        text, toxic = rng.choices(words, k=rng.randrange(0, 25)), rng.randrange(2)
        rows.append((i, " ".join(text + ["so", "awful,", "really"] if toxic else text), toxic))
    return rows


def test_features_are_the_plain_ones(labelled):
    texts = [t for _, t, _ in labelled]
    row, feature = toxicity.feature_rows([t.encode() for t in texts], 20)
    for i, t in enumerate(texts):
        assert set(feature[row == i].tolist()) == plain_features(t, 20)


def test_weights_are_those_of_plain_ftrl(spark, labelled):
    docs = spark.createDataFrame([(i, t) for i, t, _ in labelled], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled], "doc_id long, toxic int")
    order = [r.doc_id for r in labels.orderBy(F.xxhash64(F.col("doc_id").cast("string"))).collect()]
    known = {i: (plain_features(t, 20), y) for i, t, y in labelled}
    for train_rows in (1000, 120):  # the sample is the rows of least hash
        expected = plain_ftrl([known[i] for i in order[:train_rows]], toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2)
        at, values = toxicity.train(docs, labels, train_rows=train_rows)
        got = {("bias" if a == 1 << 20 else a): v for a, v in zip(at.tolist(), values.tolist())}
        assert got.keys() == expected.keys() and len(got) > 3
        assert all(abs(got[i] - w) < 1e-9 for i, w in expected.items())
    scores = {r.doc_id: r.score for r in toxicity.score(docs, (at, values), ["doc_id"]).collect()}
    for i, t, _ in labelled:
        z = sum(w for f, w in expected.items() if f == "bias" or f in known[i][0])
        assert abs(scores[i] - 1 / (1 + math.exp(-z))) < 1e-9


@pytest.mark.parametrize("totals", [[100, 100], [1000, 10, 1], [10**9, 5, 5, 5, 0], [7], [1, 2, 3, 4, 5, 6, 7, 8], [10**6] * 3 + [10]])
@pytest.mark.parametrize("entropy,repeats,budget", [(0.95, 4.0, 1.0), (0.5, 2.0, 1.0), (1.0, 1e9, 1.0), (0.0, 1.0, 0.5), (0.9, 1.5, 2.0)])
def test_exponent_is_the_one_a_grid_finds(totals, entropy, repeats, budget):
    """The largest exponent with the target entropy, but none at which a source is repeated too often."""
    live = [t for t in totals if t]
    shares = [t / sum(live) for t in live]

    def weights(x):
        raised = [s**x for s in shares]
        return [r / sum(raised) for r in raised]

    def flat(x):
        return -sum(w * math.log(w) for w in weights(x)) >= entropy * math.log(len(live)) - 1e-12

    def sparing(x):
        return all(w * budget * sum(live) <= repeats * t * (1 + 1e-12) for w, t in zip(weights(x), live))

    found = mixing.solve_exponent(totals, mixing.Mix(target_entropy=entropy, max_repeats=repeats, budget_share=budget))
    if len(live) < 2:
        assert found == 1.0
        return
    grid = [i / 2000 for i in range(2001)]
    largest_flat = max((x for x in grid if flat(x)), default=0.0)
    least_sparing = min((x for x in grid if sparing(x)), default=1.0)
    assert abs(found - max(largest_flat, least_sparing)) <= 1 / 2000


def plain_scores(train, texts, kappa):
    """The smoothed score from counts quantised as the filter holds them, by definition."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) + [None]
    words, pairs = Counter(), Counter()
    for t in train:
        words.update(split(t))
        pairs.update(zip(split(t), split(t)[1:]))
    quantised = lambda c: c if c < 2 else 1.5 * 2 ** math.floor(math.log2(c)) - 0.5
    norm = sum(words.values()) + 0.1 * (len(words) + 1)
    n1, n2 = (sum(c == k for c in pairs.values()) for k in (1, 2))
    discount = n1 / max(n1 + 2 * n2, 1)
    kept = 1 - discount * n1 / max(sum(pairs.values()), 1)
    out = []
    for t in texts:
        total, tokens = 0.0, split(t)
        for i, word in enumerate(tokens):
            p = min((quantised(words[word]) + 0.1) / norm, 1.0)
            if i:
                context, c = quantised(words[tokens[i - 1]]), pairs[tokens[i - 1], word]
                seen = 0 if not c else 1 - discount if c == 1 else min(quantised(c), context)
                w = context / (context + kappa)
                p = min(w * seen / max(context, 1) + (1 - w * kept) * p, 1.0)
            total += math.log10(p)
        out.append(total)
    return out


def test_score_is_the_plain_one(spark):
    rng = random.Random(6)
    words = [f"t{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words[: rng.choice([5, 60])], k=rng.randrange(0, 40))) for _ in range(400)] + ["", "Unseen words here", "t1 T1 t1"]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = [t for i, t in rows if i % 10]
    expected = plain_scores(train, texts, bloomlm.Smoothing().kappa)
    got = {r.doc_id: (r.score, r.n_tokens) for r in bloomlm.score(docs, F.col("doc_id") % 10 != 0).collect()}
    # What the filter reads beyond the counts (one absent level in a hundred) can only move single probabilities.
    near = sum(abs(got[i][0] - x) < 1e-9 for i, x in enumerate(expected))
    assert near >= 0.6 * len(texts)
    assert sum(abs(got[i][0] - x) for i, x in enumerate(expected)) < 0.02 * sum(n for _, n in got.values())
    # With the counts instead of the filter there is nothing between them.
    binary = pa.array([t.encode() for t in train], pa.binary())
    hashes, counts = bloomlm.tokens(binary)
    pair = bloomlm.pairs(hashes, counts)[0]
    held = Counter(hashes.tolist()) | Counter(pair.tolist())
    of_pairs = Counter(pair.tolist())
    n1, n2 = (sum(c == k for c in of_pairs.values()) for k in (1, 2))
    discount = n1 / max(n1 + 2 * n2, 1)
    model = bloomlm.Model(None, None, 64, np.zeros(0, np.uint64), np.zeros(0, np.int64), len(hashes), len(set(hashes.tolist())), discount,
                          1 - discount * n1 / len(pair))
    levels_of = lambda some: bloomlm.level(np.array([held[x] for x in some.tolist()], np.int64))
    exact = bloomlm.score_texts(pa.array([t.encode() for t in texts], pa.binary()), model, bloomlm.Smoothing(), levels_of)["score"]
    assert np.allclose(exact, expected, atol=1e-9)
