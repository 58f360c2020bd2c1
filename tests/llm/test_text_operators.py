"""The text operators against libraries and brute force, and on hard rows: nulls, empty and long texts, ties, clashes."""

import hashlib
import math
import random
import weakref
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from compare import connect, differences
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnline.llm import bloomlm, bpe, common, jaccard, mixing, tokencount, tokenfile, toxicity, urlfilter
from turnline.llm.common import read, shared_path, stored
from turnline.llm.queries import BYTE_RANKS, URL_RULES, WORD_TOKENIZER, oracle_sql, queries

WORDS = public_tokenizers.path(WORD_TOKENIZER)
RANKS = public_tokenizers.path(BYTE_RANKS)

HARD = [
    None, "", " ", " \n\t  ", "x", "a b c", "a b c", "don't we'll 'S", "<|endoftext|> a<|ENDofTEXT|>b", "日本語 テキスト" * 30,
    "ΑΣ ΟΔΟΣ é e\u0301", "a  b\n\n c ", " lead", "trail ", "long " * 9000, "z" * 3000, "\x1c a \x1d\x1eb\u00a0c", "1234 5,6.7..8",
]


@pytest.fixture(scope="module")
def hard(spark):
    """Hard texts, a null id, a repeated row, and columns named as the operators name theirs."""
    rows = [(i, t, "s" if i % 3 else None, 1, 1, 1.0, "k") for i, t in enumerate(HARD)]
    rows += [(None, "a null id has this text here", "s", 1, 1, 1.0, "k"), rows[5], rows[10]]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, node int, text_ int, score double, key string")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def byte_encoding():
    ranks = bpe.WordCoder(bpe.read_ranks(RANKS)).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(frame):
    return sorted(((r.doc_id, r.text or "") for r in frame.select("doc_id", "text").collect()), key=str)


def by_id(frame, *columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in frame.collect()), key=str)


def documents(spark, data_dir):
    return read(spark, data_dir, "documents")


@pytest.mark.parametrize("which", ["hard", "documents"])
def test_token_counts_equal_the_library(spark, data_dir, hard, tokenizer, which):
    docs = hard if which == "hard" else documents(spark, data_dir)
    found = by_id(tokencount.count_tokens(docs, WORDS, limit=20, chunk=400, overlap=16), "n_bytes", "n_tokens", "over_limit")
    ids = [(i, len(t.encode()), len(tokenizer.encode(t, add_special_tokens=False).ids)) for i, t in texts(docs)]
    assert found == sorted([(i, b, n, n > 20) for i, b, n in ids], key=str)


def test_huge_texts_splice_for_any_chunk(tokenizer):
    rnd = random.Random(5)
    parts = ["a", "B", " ", "<|endoftext|>", "'s", "1", "é", "e\u0301", "\n", "xyz" * 4, ".", "日"]
    for _ in range(200):
        text = "".join(rnd.choices(parts, k=rnd.randint(0, 90)))
        whole = tokenizer.encode(text, add_special_tokens=False).ids
        assert tokencount.encode_huge(tokenizer, text, rnd.choice([8, 16, 40]), rnd.choice([1, 3, 8])) == whole


@pytest.mark.parametrize("which", ["hard", "documents"])
def test_byte_bpe_equals_the_library(spark, data_dir, hard, byte_encoding, which):
    docs = hard if which == "hard" else documents(spark, data_dir)
    found = bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN).collect()
    ids = [(str(i), byte_encoding.encode_ordinary(t), t) for i, t in texts(docs)]
    assert sorted((str(r.doc_id), r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in found) == sorted(
        (i, len(x), np.array(x, "<u4").tobytes(), t.encode()) for i, x, t in ids
    )


def test_byte_bpe_of_long_words(byte_encoding):
    coder = bpe.WordCoder(bpe.read_ranks(RANKS))
    rnd = random.Random(3)
    words = [b"a" * 700, b"ab" * 300, bytes(rnd.choices(b"ab", k=400)), bytes(rnd.choices(b"the rna", k=500)).replace(b" ", b"s")]
    for word, (ids, decoded) in zip(words, coder.code(words)):
        assert np.frombuffer(ids, "<u4").tolist() == byte_encoding.encode_ordinary(word.decode()) and decoded == word


def test_digests(spark, data_dir, byte_encoding):
    for row in queries()["op2_byte_bpe"](spark, data_dir).limit(20).collect():
        text = documents(spark, data_dir).where(F.col("doc_id") == row.doc_id).first().text
        ids = np.array(byte_encoding.encode_ordinary(text), "<u4").tobytes()
        assert (row.ids_sha256, row.decoded_sha256) == (hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("which", ["hard", "documents"])
def test_token_files_hold_every_id_in_order(spark, data_dir, hard, tokenizer, which):
    docs = hard if which == "hard" else documents(spark, data_dir)
    path = shared_path(spark, "test")
    tokenfile.write_token_files(docs, WORDS, path, end_id=1, shards=3, segment_tokens=500)
    rows = sorted(tokenfile.read_token_files(spark, path).collect(), key=lambda r: r.start)
    names = [r.doc_id for r in rows]
    assert names == sorted(names, key=lambda i: (i is not None, i))
    assert [r.start for r in rows] == list(np.cumsum([0] + [r.n_tokens for r in rows[:-1]]))
    expected = sorted((str(i), np.array(tokenizer.encode(t, add_special_tokens=False).ids + [1], "<u4").tobytes()) for i, t in texts(docs))
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in rows) == expected
    sums = {r.doc_id: r.ids_crc32 for r in tokenfile.read_token_files(spark, path, tokenfile.CHECKSUM).collect() if r.doc_id is not None}
    assert all(sums[r.doc_id] == zlib.crc32(r.ids) for r in rows if r.doc_id is not None)


def test_segments_keep_any_numbers():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 50_000, 5000), np.zeros(5), rng.integers(0, 2**32, 900), np.r_[np.full(999, 7), 2**32 - 1], np.zeros(0)):
        ids = ids.astype(np.uint64)
        segment = tokenfile.encode_segment([1, None], [2, len(ids) - 2], ids)
        assert (tokenfile.decode_segment(segment)[2] == ids).all()
        assert (tokenfile.read_range(segment, 300, 500) == ids[300:800]).all()


def test_toxicity_on_held_out_rows(spark):
    data_dir = "/root/testdata/sf0.1"
    scored = queries()["op4_toxicity"](spark, data_dir).join(read(spark, data_dir, "labels").where("toxic is not null"), "doc_id")
    rows = scored.where("held_out").select("score", "predicted", "toxic").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit >= 0.7 * sum(r.toxic for r in rows) and hit >= 0.9 * sum(r.predicted for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_toxicity_of_hard_rows_and_without_labels(spark, hard):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (6, None), (None, 1)], "doc_id long, toxic int")
    weights = toxicity.train(hard, labels)
    rows = toxicity.score(hard, weights, hard.columns, score_column="s").collect()
    assert len(rows) == hard.count() and all(0 < r.s < 1 for r in rows)
    none = toxicity.train(hard, labels.where("toxic > 5"))
    assert {r.s for r in toxicity.score(hard, none, ["doc_id"], score_column="s").collect()} == {0.5}


def test_mix_meets_entropy_and_budget(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    rows, placed = mixing.plan(docs)
    out = mixing.realise(rows, placed, F.col("order_key"), ["doc_id", "source", "n_tokens"]).collect()
    size, taken = Counter(), Counter()
    largest = max(r.n_tokens for r in rows.collect())
    for r in rows.collect():
        size[r.source] += r.n_tokens
    weight = {}
    for r in out:
        taken[r.source] += r.n_tokens
        weight[r.source] = r.weight
    whole = sum(size.values())
    for s in size:
        assert weight[s] * whole - largest - 1 <= taken[s] <= weight[s] * whole
        assert taken[s] <= 4 * size[s]
    assert abs(sum(weight.values()) - 1) < 1e-9
    assert -sum(w * math.log(w) for w in weight.values()) >= 0.95 * math.log(len(size)) - 1e-4
    copies = Counter(r.doc_id for r in out)
    assert all({r.copy for r in out if r.doc_id == d} == set(range(n)) for d, n in list(copies.items())[:50])


def test_mix_of_hard_rows(spark, hard):
    mixed = mixing.mixed(hard)
    assert mixed.columns == hard.columns and {r.source for r in mixed.collect()} == {None, "s"}
    assert mixing.mixed(hard.where("doc_id > 999")).count() == 0
    assert mixing.solve_exponent([10, 10, 10], mixing.Mix()) == 1.0
    few = mixing.Mix(target_entropy=1.0, max_repeats=2.0)
    x = mixing.solve_exponent([1000, 10], few)
    assert max(w * 1010 / t for w, t in zip(mixing.weights_at([1000, 10], x), [1000, 10])) <= 2.0001


def language_model(docs, training):
    split = lambda t: [*(t.encode().lower().split()), None]
    counts = Counter(w for i, t in docs if training(i) for w in split(t))
    n, v = sum(counts.values()), len(counts)
    return {
        (i, t): (len(split(t)), sum(counts[w] > 0 for w in split(t)), n,
                 sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in split(t)))
        for i, t in docs
    }


@pytest.mark.parametrize("table_words", [0, 50, 1 << 20])
def test_base_scores_are_exact_and_the_model_is_better(spark, data_dir, monkeypatch, table_words):
    monkeypatch.setattr(bloomlm, "TABLE_WORDS", table_words)
    docs = documents(spark, data_dir)
    training = lambda i: zlib.crc32(str(i).encode()) % 10 != 0
    expected = {i: x for (i, _), x in language_model(texts(docs), training).items()}
    rows = queries()["op7_bloom_lm"](spark, data_dir).collect()
    assert len(rows) == len(expected)
    for r in rows:
        n, known, train, base = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, train, not training(r.doc_id))
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_language_model_of_hard_rows_and_without_training(spark, hard):
    rows = bloomlm.score(hard, F.col("doc_id") % 2 == 0).collect()
    assert len(rows) == hard.count() and all(r.score < 0 and math.isfinite(r.score) for r in rows)
    none = bloomlm.score(hard, F.lit(False)).collect()
    assert {r.train_tokens for r in none} == {0} and {r.n_known for r in none} == {0}


def test_filter_levels_are_never_too_low():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    counts = rng.geometric(0.05, 4000)
    bits = np.zeros((1 << bloomlm.SEGMENT_BITS, 1 << bloomlm.FILTER_BITS - bloomlm.SEGMENT_BITS), np.uint8)
    for s in np.unique(bloomlm.segment_of(hashes)):
        at = bloomlm.segment_of(hashes) == s
        bloomlm.fill(bits[s], hashes[at], counts[at])
    levels = bloomlm.read_levels(np.packbits(bits, axis=1).reshape(-1), hashes)
    assert (levels >= bloomlm.level(counts)).all() and (levels == bloomlm.level(counts)).mean() > 0.99


@pytest.mark.parametrize("inserted", [3, 4000, 600000])
def test_filter_grows_with_what_is_put_in(inserted):
    """The stated rate holds whatever the number of levels, and a full filter ends at the largest level."""
    rng = np.random.default_rng(3)
    hashes, absent = (rng.integers(0, 1 << 52, n).astype(np.uint64) for n in (inserted, 40000))
    bits = np.zeros(bloomlm.segment_bytes(inserted) * 8, np.uint8)
    bloomlm.fill(bits, hashes, np.ones(inserted, np.int64))
    starts = np.r_[0, np.full(1 << bloomlm.SEGMENT_BITS, len(bits))]
    read_ = bloomlm.read_levels(np.packbits(bits), absent, starts, 5)
    assert (read_ > 0).mean() < 1.5 * bloomlm.FALSE
    assert set(bloomlm.read_levels(np.full(len(bits) // 8, 255, np.uint8), absent[:9], starts, 5)) == {5}


def test_scores_do_not_depend_on_how_the_filter_is_read(spark, data_dir, hard, monkeypatch):
    """A filter beyond the broadcast bound is asked in its segments."""
    for docs in (stored(documents(spark, data_dir).limit(300), "some"), hard):
        fits = F.coalesce(F.col("doc_id"), F.lit(0)) % 10 != 0
        rows = {}
        for bound in (bloomlm.FILTER_BITS, 0):
            monkeypatch.setattr(bloomlm, "FILTER_BITS", bound)
            rows[bound] = sorted(map(tuple, bloomlm.score(docs, fits).collect()), key=str)
            monkeypatch.undo()
        assert rows[0] == rows[bloomlm.FILTER_BITS] and len(rows[0]) == docs.count()


def test_lists_of_a_segment_are_answered_together(monkeypatch):
    """A large corpus asks each segment in thousands of short lists: one reading per batch and segment, not one per list."""
    rng = np.random.default_rng(7)
    inside = [np.sort(rng.integers(k << 52, k + 1 << 52, 300).astype(np.uint64)) for k in range(3)]
    bits = []
    for hashes in inside[:2]:  # nothing is in the third segment
        filled = np.zeros(bloomlm.segment_bytes(600) * 8, np.uint8)
        bloomlm.fill(filled, hashes, np.full(300, 3))
        bits.append(np.packbits(filled))
    rows = []
    for k in range(3):
        rows += [(None, k, bits[k].tobytes())] if k < 2 else []
        rows += [(i, k, np.sort(rng.choice(inside[k], i % 4)).tobytes()) for i in range(200)]
    types = (pa.int64(), pa.int64(), pa.binary())
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["slice", "segment", "data"])
    calls, read_levels = [], bloomlm.read_levels
    monkeypatch.setattr(bloomlm, "read_levels", lambda *a: calls.append(1) or read_levels(*a))
    got = [r for batch in bloomlm.answers_of(iter(table.to_batches(150)), 9) for r in batch.to_pylist()]
    assert len(calls) <= 2 + 5
    assert [(r["slice"], r["segment"]) for r in got] == [(i, k) for i, k, _ in rows if i is not None]
    for r, (_, k, asked) in zip(got, [r for r in rows if r[0] is not None]):
        starts = np.where(np.arange((1 << bloomlm.SEGMENT_BITS) + 1) > k, len(bits[k]) * 8 if k < 2 else 0, 0)
        expected = read_levels(bits[k], np.frombuffer(asked, np.uint64), starts, 9) if k < 2 else np.zeros(len(asked) // 8)
        assert np.frombuffer(r["data"], np.uint8).tolist() == expected.tolist()


def test_texts_are_not_stored_to_be_asked(spark, monkeypatch):
    """Where the filter stays in its segments, texts are shuffled once and n-grams once: neither is written besides."""
    names = []
    monkeypatch.setattr(bloomlm, "FILTER_BITS", 0)
    monkeypatch.setattr(bloomlm, "ASKED_BYTES", 2000, raising=False)  # several slices
    monkeypatch.setattr(bloomlm, "stored", lambda frame, name: names.append(set(frame.columns)) or stored(frame, name))
    rows = [(i if i % 7 else None, f"a b c{i % 50} d e{i}" if i % 5 else None, i % 3 > 0) for i in range(400)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, fits boolean").repartition(5)
    asked = sorted(map(tuple, bloomlm.score(docs, F.col("fits")).collect()), key=str)
    monkeypatch.setattr(bloomlm, "FILTER_BITS", 30)
    assert asked == sorted(map(tuple, bloomlm.score(docs, F.col("fits")).collect()), key=str) and len(asked) == 800
    assert not any(c & {"text", "text_", "data"} for c in names)


def test_pairs_seen_once_raise_the_score(spark):
    """Two texts of the same words: the pairs of one occur once in training, those of the other never."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    trained = [" ".join(rnd.sample(words, 40)) for _ in range(20)]
    seen = {p for t in trained for p in zip(t.split(), t.split()[1:])}
    new = trained[0].split()
    while any(p in seen for p in zip(new, new[1:])):
        rnd.shuffle(new)
    rows = [(i, t, True) for i, t in enumerate(trained)] + [(100, trained[0], False), (101, " ".join(new), False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fits boolean")
    scores = {r.doc_id: r.score for r in bloomlm.score(docs, F.col("fits")).collect()}
    assert scores[100] > scores[101] + 4


def sets_of(docs):
    out = []
    for i, t in docs:
        w = t.encode().lower().split()
        out.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())))
    return out


def components(sets):
    label = list(range(len(sets)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                label[root(a)] = root(b)
    groups = {}
    for k in range(len(sets)):
        groups.setdefault(root(k), []).append(sets[k][0])
    least = {r: min((i for i in g if i is not None), default=None) for r, g in groups.items()}
    return sorted(((sets[k][0], len(sets[k][1]), least[root(k)]) for k in range(len(sets))), key=str)


@pytest.mark.parametrize("seed, words", [(1, 9), (2, 14), (3, 40)])
def test_no_link_between_small_sets_is_lost(spark, seed, words):
    """Short texts from few words, edited again and again: many sets just above and below the threshold."""
    rnd = random.Random(seed)
    rows = []
    for i in range(260):
        if rows and rnd.random() < 0.8:
            text = rnd.choice(rows)[1].split()
            for _ in range(rnd.randint(0, 2)):
                at = rnd.randrange(len(text) + 1)
                text[at : at + rnd.randint(0, 1)] = rnd.choices("pqrstuvwxyz", k=rnd.randint(0, 2))
        else:
            text = rnd.choices("abcdefghijkl", k=rnd.randint(1, words))
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(jaccard.near_duplicates(docs), "n_shingles", "component_id") == components(sets_of(rows))


def test_jaccard_of_hard_rows_and_one_of_each_group_stays(spark, hard):
    found = jaccard.near_duplicates(hard)
    assert by_id(found, "n_shingles", "component_id") == components(sets_of(texts(hard)))
    kept = jaccard.keep_one(hard)
    assert kept.columns == hard.columns
    held = {(i, len(s)) for i, s in sets_of(texts(hard))}
    assert kept.count() == len(held) - 2  # "a b c" three times, and two rows repeated
    assert jaccard.near_duplicates(hard.where("doc_id > 999")).count() == 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_equal_sql(spark, data_dir, name):
    connection = connect(data_dir)
    assert differences(queries()[name](spark, data_dir), connection, oracle_sql()[name]) == []


def test_url_rules(spark):
    urls = {
        None: ("", "", None, "allow"), "no-scheme.com/": ("", "", None, "allow"), "http://A.Com": ("a.com", "", None, "allow"),
        "http://x.example.com/en/1": ("x.example.com", "/en/1", "example.com/en/", "block"),
        "https://www.EXAMPLE.com/en/?a#b": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://net/es/": ("net", "/es/", "net/es/", "block"), "https://xnet/es/": ("xnet", "/es/", None, "allow"),
        "http://b.com/?x/y": ("b.com", "/", "com/", "allow"), "h://c.com#/en/": ("c.com", "", None, "allow"), "": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(1, u, "h", "r") for u in urls] * 2, "page_id long, url string, host string, rule string")
    rows = urlfilter.filter_urls(pages, urlfilter.rules_frame(spark, URL_RULES)).collect()
    assert sorted(map(str, (tuple(r)[1:] for r in rows))) == sorted(map(str, list(urls.values()) * 2))
    assert urlfilter.filter_urls(pages, urlfilter.rules_frame(spark, URL_RULES).limit(0)).where("verdict = 'allow'").count() == len(urls) * 2


def test_blanks_indented_lines_and_long_words_equal_tiktoken():
    """Texts that spaces alone do not cut, and words that no space cuts, whose pairs are contracted together."""
    coder = bpe.TextCoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    coding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.words.ranks, special_tokens={})
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choices(letters, k=rng.randrange(1, 12))) for _ in range(50)] + ["", "", "é", "日本語", "12", "\n", "\t", "    "]
    texts = [rng.choice([" ", "  ", "\n  ", "\n\n    "]).join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(300)]
    texts += ["", " ", "  ", "\n", " a", "  a ", "a  ", "def f():\n        return  1\n"]
    texts += ["".join(rng.choices(alphabet, k=n)) for alphabet in (letters, "ab", "a", "etaoin", "日本語中文", "éèê", "0123456789abcdef")
              for n in (65, 300, 3000)]
    texts += ["".join(rng.choices(words[:20], k=400)), "ab" * 2000, "x" * 5001, "the" * 1000 + "q" + "the" * 999]
    ids, decoded = coder.texts(pa.array(texts))
    for text, own, back in zip(texts, ids, decoded):
        assert np.frombuffer(own, "<u4").tolist() == coding.encode_ordinary(text), text[:80]
        assert back == text.encode()


def test_a_word_of_many_letters_takes_few_steps():
    """A hundred thousand letters in no order: bounded by the steps that contract them together."""
    import time

    coder = bpe.TextCoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    coding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.words.ranks, special_tokens={})
    word = "".join(random.Random(7).choices("abcdefghijklmnopqrstuvwxyz", k=100_000))
    began = time.monotonic()
    ids, decoded = coder.texts(pa.array([word]))
    assert time.monotonic() - began < 60
    assert np.frombuffer(ids[0], "<u4").tolist() == coding.encode_ordinary(word) and decoded[0] == word.encode()


def test_words_of_usual_length_take_little_work_and_decode_to_themselves(byte_encoding):
    """Pairs of bytes that nothing reaches into are contracted at once, so fewer rows go through the steps."""
    coder, rng = bpe.WordCoder(bpe.read_ranks(RANKS)), random.Random(11)
    parts = ["ed", "enti", "ing", "ou", "th", "re", "and", "keit", "zu", "ció", "aa", "t", "ß", "é"]
    words = list(dict.fromkeys(" " + "".join(rng.choices(parts, k=rng.randrange(2, 7))) for _ in range(2000)))
    words += ["a" * n for n in range(1, 65)] + ["".join(rng.choices("ab", k=n)) for n in range(2, 65)]
    words = list(dict.fromkeys(w for w in words if len(w.encode()) <= bpe.LONG_WORD))
    for word, (ids, decoded) in zip(words, coder.code([w.encode() for w in words])):
        assert np.frombuffer(ids, "<u4").tolist() == byte_encoding._core_bpe.encode_single_piece(word.encode())
        assert decoded == word.encode()
    usual = [w.encode() for w in words[:2000] if w.startswith(" ")]
    coder.code(usual)
    [(stepped,)] = coder.db.sql(bpe.SHORT_WORDS + "SELECT count(*) FROM state").fetchall()
    assert stepped < 3 * sum(map(len, usual))


def test_a_worker_frees_what_it_forgets():
    """A coder and its memo refer to each other: dropped, they go at once, not when the collector comes round."""
    coder = common.per_worker("test", lambda: bpe.TextCoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN))
    gone = weakref.ref(coder)
    del coder
    common.forget()
    assert gone() is None


TAILED = ["foo", "foo,", "foo.", "foo!!", "foo.%%%", "é***", "é,", "×,", "÷.", "e\u0301,", "e\u0301", "ñ<", "7.", "77,5;", "'s,", "x's", "x's'",
          "…,", "ß…", "don't!", "'", "',", "a'", "a\nb,", "Á?", "中,", "中", "ǅ.", "¼,", "_", "a_", "{a}", "ﬁ.", "İ,", "<|x|>"]


def test_a_word_is_remembered_once_whatever_punctuation_ends_it(tokenizer):
    content = tokencount.read_text(WORDS)
    coder = tokencount.PieceCoder(content)
    texts = [*TAILED, " ".join(TAILED), "", "  ", "\n".join(reversed(TAILED))]
    got = coder.encode(pa.array([t.encode() for t in texts], pa.binary()))
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    coder = tokencount.PieceCoder(content)
    coder.encode(pa.array([b" ".join(w + t for w in (b"one", b"two", b"\xc3\xb1u") for t in (b"", b",", b".", b"!!", b"***"))], pa.binary()))
    assert len(coder.memo.young) == 3 + 5  # the words, and what ends them
    assert coder.encode(pa.array([], pa.binary())) == []


def test_byte_words_are_coded_once_whatever_punctuation_ends_them(byte_encoding, monkeypatch):
    coder = bpe.TextCoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    texts = [*TAILED, " ".join(TAILED), "", "  ", "a  b,\n\n c. ", *(f" {t}" for t in TAILED), "\n".join(reversed(TAILED))]
    ids, decoded = coder.texts(pa.array(texts))
    for text, x, y in zip(texts, ids, decoded):
        assert np.frombuffer(x, "<u4").tolist() == byte_encoding.encode_ordinary(text), text
        assert y == text.encode()
    assert coder.texts(pa.array([], pa.string())) == ([], [])
    coder = bpe.TextCoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    coded = []
    monkeypatch.setattr(coder.words, "code", lambda words, code=coder.words.code: coded.extend(words) or code(words))
    for tail in ("", ",", ".", "!!", "***"):
        coder.texts(pa.array([" ".join(["so", *(w + tail for w in ("one", "two", "ñu"))])]))
    assert sorted(coded) == sorted([b"so", b" so", b" one", b" two", " ñu".encode(), b",", b".", b"!!", b"***"])
