"""The operators as registered queries, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnline.llm import (
    ballcodes, bloomlm, bpe, chat, graph, jaccard, mixing, prefixtrie, simhash, tokencount, tokenfile, toxicity, urlfilter,
)
from turnline.llm.common import read, shared_path

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"

URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), limit=2048)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(read(spark, sf_dir, "documents"))


def byte_bpe(docs: DataFrame) -> DataFrame:
    return bpe.encode_decode(docs, public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN, bpe.DIGESTS)


def op3_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def toxicity_weights(spark: SparkSession, sf_dir: str):
    labels = read(spark, sf_dir, "labels").where(toxicity.fold(F.col("doc_id"), 4) != 2)
    return toxicity.train(read(spark, sf_dir, "documents"), labels)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_weights(spark, sf_dir), ["doc_id"])
    return scored.select(
        "doc_id", (toxicity.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= toxicity.TOXIC_FROM).cast("int").alias("predicted"),
    )


def op5_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_vectors(read(spark, sf_dir, "embeddings"), threshold=0.9)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, placed = mixing.plan(read(spark, sf_dir, "documents"))
    return mixing.realise(rows, placed, F.col("order_key"), ["doc_id", "source", "n_tokens"])


def op7_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloomlm.score(read(spark, sf_dir, "documents"), toxicity.fold(F.col("doc_id"), 10) != 0)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(read(spark, sf_dir, "pages"), urlfilter.rules_frame(spark, URL_RULES))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    tokenfile.write_token_files(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), path, end_id=1)
    return tokenfile.read_token_files(spark, path, tokenfile.CHECKSUM)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(prefixtrie.paths_of(read(spark, sf_dir, "conversations"), group=20))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ballcodes.code_rows(*ballcodes.compress(read(spark, sf_dir, "embeddings")))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat_digests(conversations.unionByName(tricky))


def chat_digests(conversations: DataFrame) -> DataFrame:
    """Formatted conversations, read back: turns from the formatted text, the loss from the segments under it."""
    segments = F.col("segments")
    written = chat.format_chats(conversations).select(
        "conv_id", "first_error", chat.formatted(segments).alias("formatted"), chat.loss_text(segments).alias("loss")
    )
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return written.withColumn("turns", chat.parse(F.col("formatted"))).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), F.col("first_error").cast("long").alias("first_error"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_token_counts, op2_byte_bpe, op3_graph_neighbours, op4_toxicity, op5_vector_near_dedup, op6_mixing,
        op7_bloom_lm, op8_ngram_jaccard, op9_url_filter, op10_token_files, op11_prefix_trie, op12_vector_codes, op13_chat_format,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op8_ngram_jaccard": NGRAM_JACCARD, "op9_url_filter": URL_FILTER, "op11_prefix_trie": PREFIX_TRIE,
        "op12_vector_codes": vector_codes_sql(), "op13_chat_format": chat_format_sql(),
    }


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NGRAM_JACCARD = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b USING (shingle)
  WHERE a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common.n >= 75 * (x.n + y.n - common.n)
), ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM ways UNION SELECT reach.a, ways.b FROM reach JOIN ways ON ways.a = reach.b)
SELECT d.doc_id, coalesce(any_value(sizes.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(reach.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id
"""

URL_FILTER = f"""
WITH rules(verdict, rule_host, rule_path) AS (VALUES {", ".join(map(str, URL_RULES))}),
rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0
    THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), '{UPPER}', '{LOWER}') AS host,
         CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM rest
), fits AS (
  SELECT host, path, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host) + length(rule_path) DESC,
                            length(rule_host) DESC, verdict = 'block' DESC) AS place
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (host, path)
"""

# CRC-32 bit by bit: eight steps per byte of the decimal id.
CRC_STEP = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
CRC = f"""xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: {CRC_STEP})), 4294967295)"""

PREFIX_TRIE = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id AS c, conv_id - conv_id % 20 AS head, {CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT c, pos, role, text FROM ids JOIN turns ON conv_id = head AND pos <= h
  UNION ALL SELECT c, pos, role, text FROM ids JOIN turns ON conv_id = c AND pos > h
), placed AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         md5(length(role) || ':' || role || text) AS turn FROM rebuilt
), prefixes AS (
  SELECT c, d, words, md5(string_agg(turn, '') OVER (PARTITION BY c ORDER BY d)) AS node FROM placed
  UNION ALL SELECT c, 0, 0, 'root' FROM ids
), nodes AS (
  SELECT node, any_value(d) AS depth, any_value(words) AS words, min(c) AS conv_id, count(*) AS n_convs FROM prefixes GROUP BY node
), parents AS (SELECT n.node, p.node AS parent FROM nodes n JOIN prefixes p ON p.c = n.conv_id AND p.d = n.depth - 1),
children AS (SELECT parent AS node, count(*) AS n FROM parents GROUP BY parent),
sums AS (
  SELECT a.node, count(*) FILTER (ch.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved
  FROM nodes n LEFT JOIN children ch USING (node) JOIN prefixes a ON a.c = n.conv_id AND a.d <= n.depth GROUP BY a.node
), ends AS (
  SELECT node, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends_sha256
  FROM (SELECT c, arg_max(node, d) AS node FROM prefixes GROUP BY c) GROUP BY node
)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(ch.n, 0) AS n_children,
       s.n_leaves, s.saved::BIGINT AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM nodes n JOIN sums s USING (node) LEFT JOIN children ch USING (node) LEFT JOIN ends e USING (node)
LEFT JOIN parents p USING (node) LEFT JOIN nodes up ON up.node = p.parent
"""


def vector_codes_sql() -> str:
    def nearest(n: int) -> str:
        return f"""near{n} AS MATERIALIZED (
  SELECT r, p, any_value(v) AS v, min(gap * 64 + e) AS best FROM (
    SELECT r, a.p, v, e, list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS gap
    FROM pieces a JOIN book{n} b ON a.p = b.p) GROUP BY r, p)"""

    def book(n: int) -> str:
        return f"""book{n} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{n - 1} b LEFT JOIN (
    SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM (
      SELECT p, best % 64 AS e, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM near{n - 1}, range(1, 1025) t(i) WHERE i <= len(v)
      GROUP BY ALL) GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)"""

    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
         list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pieces AS MATERIALIZED (
  SELECT r, p, x[p * len(x) // 16 + 1 : (p + 1) * len(x) // 16] AS v FROM kept, range(16) t(p)
), book0 AS MATERIALIZED (SELECT p, r - 1 AS e, v AS c FROM pieces WHERE r <= 64),
{nearest(0)}, {book(1)}, {nearest(1)}, {book(2)}, {nearest(2)},
coded AS (
  SELECT r, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error FROM near2 GROUP BY r
), books AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), books
"""


def chat_format_sql() -> str:
    template = chat.BRACKETS
    moves = ", ".join(f"('{state}', '{role}')" for state, role, _ in template.moves)
    marks = " ".join(f"WHEN '{name}' THEN {len(m.before) + len(m.after)}" for name, m in template.roles.items())
    named = len(template.other.before) + len(template.name_end) + len(template.other.after)

    def escaped(text: str) -> str:
        return f"""regexp_replace({text}, '(<)(\\\\*)(s>|/s>)|(\\[)(\\\\*)(SYS\\]|/SYS\\]|INST\\]|/INST\\]|OUT\\]|ROLE\\]|/ROLE\\]|TEXT\\])',
            '\\1\\4\\\\\\2\\5\\3\\6', 'g')"""

    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
), placed AS (
  SELECT *, row_number() OVER w AS place, coalesce(lag(role) OVER w, 'start') AS before,
         CASE role {marks} ELSE {named} + length({escaped("role")}) END + length({escaped("text")}) AS chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY place) AS turns,
         coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS loss,
         sum(chars)::BIGINT + {len(template.begin)} AS formatted_chars, arg_max(role, place) AS last_role,
         min(place) FILTER ((before, role) NOT IN ({moves})) AS wrong
  FROM placed GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
       coalesce(wrong, CASE WHEN last_role <> 'assistant' THEN n_turns + 1 END) AS first_error
FROM whole
"""
