"""The stages on what the one before kept."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken
from compare import connect  # noqa: F401
from pyspark.sql import functions as F
from test_text_operators import RANKS, components, sets_of, texts

import corpus_pipeline
from turnline.llm import bpe, mixing, toxicity
from turnline.llm.common import read, stored
from turnline.llm.queries import byte_bpe, toxicity_weights


def test_stages_take_effect_and_keep_the_columns(spark):
    data_dir = "/root/testdata/sf0.01"
    docs = read(spark, data_dir, "documents")
    clean = corpus_pipeline.drop_toxic(spark, docs, data_dir)
    scores = toxicity.score(docs, toxicity_weights(spark, data_dir), ["doc_id"])
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in scores.where(F.col("score") < 0.3).collect()}
    single = corpus_pipeline.drop_near_duplicates(spark, clean, data_dir)
    assert single.columns == docs.columns and 0 < single.count() < clean.count()
    mixed = corpus_pipeline.mix_sources(spark, single, data_dir)
    assert mixed.columns == docs.columns
    rows = corpus_pipeline.run(spark, data_dir)
    assert rows.columns == byte_bpe(docs).columns
    assert sorted(r.doc_id for r in rows.collect()) == sorted(r.doc_id for r in mixed.collect())


def mixed_ids(rows, mix=mixing.Mix()):
    """How often each id is taken, from (id, source, text): budgets of whole copies, and of one more up to the first that does not fit."""
    key = lambda i, s: int(hashlib.md5(f"mix|{s}|{i}".encode()).hexdigest()[:15], 16)
    sources = {}
    for i, s, t in rows:
        sources.setdefault(s, []).append((key(i, s), len(re.findall(r"[^\x20\x09-\x0D]+", t)), i))
    totals = [sum(n for _, n, _ in found) for found in sources.values()]
    weights = mixing.weights_at(totals, mixing.solve_exponent(totals, mix))
    out = Counter()
    for found, total, weight in zip(sources.values(), totals, weights):
        copies, left = divmod(int(weight * sum(totals)), total)
        fits = True
        for _, n, i in sorted(found):
            fits, left = fits and n <= left, left - n
            out[i] += copies + fits
    return +out


def test_stages_keep_what_plain_python_keeps(spark):
    data_dir = "/root/testdata/sf0.001"
    clean = stored(corpus_pipeline.drop_toxic(spark, read(spark, data_dir, "documents"), data_dir), "clean")
    single = stored(corpus_pipeline.drop_near_duplicates(spark, clean, data_dir), "single")
    least = {i for i, n, least in components(sets_of(texts(clean))) if not n or i == least or least is None}
    assert sorted(r.doc_id for r in single.collect()) == sorted(least) and len(least) < clean.count()
    rows = [(r.doc_id, r.source, r.text or "") for r in single.collect()]
    expected = mixed_ids(sorted(rows, key=lambda r: r[1]))
    mixed = corpus_pipeline.mix_sources(spark, single, data_dir)
    assert Counter(r.doc_id for r in mixed.collect()) == expected
    even = mixing.Mix(target_entropy=1.0)  # some sources are cut, some repeated
    cut = mixed_ids(sorted(rows, key=lambda r: r[1]), even)
    assert Counter(r.doc_id for r in mixing.mixed(single, even).collect()) == cut and max(cut.values()) > 1 and len(cut) < len(rows)
    ranks = bpe.WordCoder(bpe.read_ranks(RANKS)).ranks
    coding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = {i: (hashlib.sha256(np.array(coding.encode_ordinary(t), "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
              for i, _, t in rows}
    out = corpus_pipeline.run(spark, data_dir).collect()
    assert Counter(r.doc_id for r in out) == expected
    assert all((r.ids_sha256, r.decoded_sha256) == digest[r.doc_id] for r in out)


WORKING = (
    "cut", "blocks", "row_key", "mix_weight", "mix_source", "mix_copies", "mix_copy", "row_source", "copy", "weight", "text_", "text__",
    "toxicity_score", "score", "key", "node", "label", "label_", "order_", "n", "x", "sketch", "id_", "id__", "hash__", "hash_", "stays",
    "group", "text_hash", "component_id", "times", "head", "bucket", "tokens", "n_tokens", "ids", "decoded", "shard", "row", "hash", "count",
)


def test_every_working_name_may_be_a_column(spark):
    """Stages keep columns of any names, and operators return the same whatever else a table holds."""
    data_dir = "/root/testdata/sf0.001"
    plain = read(spark, data_dir, "documents")
    docs = plain.withColumns({name: F.concat(F.lit(name), F.col("doc_id").cast("string")) for name in WORKING})
    expected = plain
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, expected = stored(stage(spark, docs, data_dir), "wide"), stored(stage(spark, expected, data_dir), "plain")
        assert docs.columns == [*plain.columns, *WORKING]
        assert Counter(r.doc_id for r in docs.collect()) == Counter(r.doc_id for r in expected.collect()), name
        assert docs.where(F.concat(F.lit("cut"), F.col("doc_id").cast("string")) != F.col("cut")).isEmpty()
    last = corpus_pipeline.STAGES[-1][1]
    assert sorted(map(tuple, last(spark, docs, data_dir).collect())) == sorted(map(tuple, last(spark, expected, data_dir).collect()))


def test_stages_of_an_empty_table(spark):
    data_dir = "/root/testdata/sf0.001"
    docs = read(spark, data_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, data_dir), "empty")
        assert docs.isEmpty()
