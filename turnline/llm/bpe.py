"""Byte-level BPE: recursive DuckDB queries per partition encode words, ordered aggregation decodes them.

A text falls into the matches of a pattern (words).  The distinct words of a
partition become token-position rows, one per byte.  A recursive query joins
neighbouring positions with the merge table and contracts, word by word, the
leftmost pair of least rank until no pair can merge.  Before that, in short words, every pair of bytes
is contracted that ranks before all tokens that hold two bytes across either end of it: none of them can
reach into it before its turn, so their order does not matter.  In long words, pairs are
contracted together where the order cannot matter: equal pairs, if no token that begins
or ends with the merged one ranks before it, and pairs of less rank than every token that
their neighbours make up across either end of them, since nothing reaches into them before
their turn.  So a word of letters in no order takes some dozens of steps, not one per merge.
Aggregation of the position rows in order gives ids and, joined with the
vocabulary, the decoded bytes, which must be the word again.  Documents are then put together from their words.

Nulls and empty texts have no tokens; an empty table gives no rows.  Repeated rows give
repeated results.  The time grows with the distinct pieces of a partition.  Texts with runs
of blanks or indented lines are cut into pieces too, and remembered like others.  Very long
texts and words are coded whole; a word of n bytes costs n rows per step.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from turnline.llm.common import Memo, arrow_map, as_bytes, heads_and_tails, out_schema, per_worker, slices

#: Bytes of text that a worker encodes at a time.
CODED_BYTES = 4 << 20

#: Position rows that one recursive query starts from (a longer word is a query of its own).
QUERY_ROWS = 200_000

#: A space after something that is no white space: no match of the pattern crosses it.
CUT = re.compile(r"(?<=\S)(?= )")

#: More than any rank.
BEYOND = 2**31 - 1

#: Words of more bytes are contracted in place; shorter ones keep the rows of each step until the query ends.
LONG_WORD = 64

SHORT_WORDS = """
WITH RECURSIVE marked AS (
  SELECT (word * 64 + place)::INTEGER AS spot, token::USMALLINT AS token,
         CASE WHEN word = lead(word) OVER w THEN token * 65536::UINTEGER + lead(token) OVER w END AS pair
  FROM begin_state WINDOW w AS (ORDER BY word, place)
), ranked_bytes AS (
  SELECT spot, token, merged, cut, lag(merged) OVER w AS merged_before, lag(cut, 2) OVER w AS cut_before_that,
         lag(cut) OVER w AS cut_before, lead(cut) OVER w AS cut_after
  FROM marked LEFT JOIN byte_pairs USING (pair) WINDOW w AS (ORDER BY spot)
), apart AS (
  SELECT spot, (CASE WHEN merged < coalesce(cut_before, 2147483647) AND merged <= coalesce(cut_after, 2147483647)
                THEN merged ELSE token END)::USMALLINT AS token
  FROM ranked_bytes
  WHERE NOT coalesce(merged_before < coalesce(cut_before_that, 2147483647) AND merged_before <= coalesce(cut, 2147483647), false)
), state(spot, token, open) AS (
  SELECT spot, token, true FROM apart
  UNION ALL
  (
    WITH pairs AS (
      SELECT spot, token, lead(spot) OVER w AS next_spot, lead(token) OVER w AS next_token
      FROM state WHERE open WINDOW w AS (ORDER BY spot)
    ),
    ranked AS (
      SELECT spot, token, next_spot, merged, merged * 64 + (spot & 63) AS preference
      FROM pairs LEFT JOIN merges
        ON merges.pair = CASE WHEN spot >> 6 = next_spot >> 6 THEN token * 65536::UINTEGER + next_token END
    ),
    least AS (
      SELECT spot >> 6 AS word, min(preference) AS best, arg_min(next_spot, preference) AS gone FROM ranked GROUP BY word
    )
    SELECT spot, (CASE WHEN preference = best THEN merged ELSE token END)::USMALLINT, best IS NOT NULL
    FROM ranked JOIN least ON spot >> 6 = word WHERE best IS NULL OR spot <> gone
  )
), done AS (SELECT spot >> 6 AS word, spot & 63 AS place, token::INTEGER AS token FROM state WHERE NOT open)
"""

LONG_WORDS = """
WITH RECURSIVE state(word, place, token, cut, step) USING KEY (word, place) AS (
  SELECT word, place, token, cut, 0 FROM begin_state
  UNION
  (
    WITH alive AS (
      SELECT word, place, token, cut, (SELECT max(step) FROM state) AS step FROM recurring.state
      WHERE token >= 0 AND word IN (SELECT word FROM state)
    ),
    pairs AS (
      SELECT word, place, token, lead(token) OVER w AS next_token, lead(place) OVER w AS next_place, cut,
             lead(cut, 2, 2147483647) OVER w AS end_cut, row_number() OVER w AS nth, step
      FROM alive WINDOW w AS (PARTITION BY word ORDER BY place)
    ),
    ranked AS (
      SELECT word, place, next_place, cut, nth, step, merges.merged, merges.any_order,
             merges.merged < cut AND merges.merged < end_cut AS apart,
             min(merges.merged) OVER (PARTITION BY word) AS least
      FROM pairs JOIN merges ON merges.pair = pairs.token * 65536::UINTEGER + pairs.next_token
    ),
    found AS (
      SELECT *, row_number() OVER (PARTITION BY word ORDER BY nth) AS hit FROM ranked WHERE merged = least AND step = 0
    ),
    chosen AS (
      SELECT *, row_number() OVER (PARTITION BY word, nth - hit ORDER BY nth) % 2 AS odd FROM found
    ),
    contracted AS (
      SELECT word, place, next_place, cut, merged, step FROM chosen WHERE hit = 1 OR (any_order AND odd = 1)
      UNION
      SELECT word, place, next_place, cut, merged, step FROM ranked WHERE apart
    )
    SELECT word, place, merged, cut, step + 1 FROM contracted
    UNION ALL
    SELECT word, next_place, -1, 0, step + 1 FROM contracted
  )
), done AS (SELECT word, place, token FROM state WHERE token >= 0)
"""

AS_STATE = "SELECT word, place, token FROM done ORDER BY word, place"

AS_IT_IS = "WITH done AS (SELECT word, place, token FROM begin_state)"

IN_ORDER = """
SELECT word, list(token) AS ids, list(bytes) AS decoded
FROM (SELECT word, token, bytes FROM done JOIN vocabulary USING (token) ORDER BY word, place) GROUP BY word ORDER BY word
"""


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


class WordCoder:
    """The recursive queries over one vocabulary, in a DuckDB of this process's own."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        if max(self.ranks.values()) >= 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.heads: set[bytes] = set()
        self.content: dict[int, bytes] = {}
        pairs, merged, late = [], [], set()
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                late.update(x for x in (left, right) if x is not None and x > rank)
                if left is not None and right is not None:
                    pairs.append(left << 16 | right)
                    merged.append(rank)
        self.bytes_of = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        cuts: dict[bytes, int] = {}
        for token, rank in self.ranks.items():
            for i in range(len(token) - 1):
                two = token[i:i + 2]
                if rank < cuts.get(two, BEYOND):
                    cuts[two] = rank
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "100MB"})
        # A pair's places may be contracted together if no token begins or ends with the merged one and ranks before it.
        self._table("merges", pair=pa.array(pairs, pa.uint32()), merged=pa.array(merged, pa.int32()),
                    any_order=pa.array([m not in late for m in merged]))
        # For two bytes their token and the least rank of any token that holds them side by side.
        self._table("byte_pairs", pair=pa.array([int(self.bytes_of[a]) << 16 | int(self.bytes_of[b]) for a, b in cuts], pa.uint32()),
                    merged=pa.array(map(self.ranks.get, cuts), pa.int32()), cut=pa.array(cuts.values(), pa.int32()))
        self._table("vocabulary", token=pa.array(list(self.ranks.values()), pa.int32()),
                    bytes=pa.array(list(self.ranks), pa.binary()))

    def _table(self, name: str, **columns) -> None:
        self.db.register(f"{name}_rows", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM {name}_rows")
        self.db.unregister(f"{name}_rows")

    def _cuts(self, word: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, bool]:
        """For each position the least rank of any token that neighbouring tokens make up across the boundary before
        it, and whether any pair can merge at all.

        No merge crosses that boundary before its turn, so a pair of less rank than both its ends' is merged whatever
        happens elsewhere: such pairs need not wait for each other.
        """
        if not self.heads:
            self.heads.update(t[:i] for t in self.ranks for i in range(2, len(t)))
            self.content = {rank: t for t, rank in self.ranks.items()}
        heads, ranks, cuts, open_ = self.heads, self.ranks, [BEYOND] * len(token), False
        parts = list(map(self.content.__getitem__, token.tolist()))
        bounds = np.flatnonzero(np.r_[True, word[1:] != word[:-1], True])
        ends = np.repeat(bounds[1:], np.diff(bounds))
        for start, last in enumerate(ends.tolist()):
            part = parts[start]
            for end in range(start + 1, last):
                part += parts[end]
                rank = ranks.get(part)
                if rank is not None:
                    open_ = open_ or end == start + 1
                    for at in range(start + 1, end + 1):
                        if rank < cuts[at]:
                            cuts[at] = rank
                if part not in heads:
                    break
        return np.array(cuts, np.int32), open_

    def code(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids (little-endian, 32 bits) and decoded bytes of each word."""
        coded: dict[bytes, tuple[bytes, bytes]] = {}
        for contract, some in (
            (SHORT_WORDS, [w for w in words if 0 < len(w) <= LONG_WORD]), (LONG_WORDS, [w for w in words if len(w) > LONG_WORD])
        ):
            sizes, start = np.cumsum([0, *map(len, some)]), 0
            while start < len(some):
                end = max(start + 1, int(np.searchsorted(sizes, sizes[start] + QUERY_ROWS, "right")) - 1)
                coded.update(zip(some[start:end], self._query(contract, some[start:end])))
                start = end
        return [coded[w] for w in words]

    def _query(self, contract: str, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        # A word that is a token is that token; any other starts as its bytes.
        known = [self.ranks.get(w) for w in words]
        rest = [w for w, k in zip(words, known) if k is None]
        lengths = np.array([len(w) if k is None else 1 for w, k in zip(words, known)], np.int64)
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        place = (np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        token = np.empty(len(word), np.int32)
        whole = np.array([k is not None for k in known])
        token[np.repeat(whole, lengths)] = [k for k in known if k is not None]
        token[np.repeat(~whole, lengths)] = self.bytes_of[np.frombuffer(b"".join(rest), np.uint8)]
        while contract is LONG_WORDS and len(token):
            cut, open_ = self._cuts(word, token)
            if not open_:
                break
            self._table("begin_state", word=pa.array(word), place=pa.array(place), token=pa.array(token), cut=pa.array(cut))
            word, place, token = (c.to_numpy() for c in self.db.sql(LONG_WORDS + AS_STATE).to_arrow_table().columns)
        self._table("begin_state", word=pa.array(word), place=pa.array(place), token=pa.array(token))
        result = self.db.sql((AS_IT_IS if contract is LONG_WORDS else contract) + IN_ORDER).to_arrow_table()
        lists, parts = result["ids"].combine_chunks(), result["decoded"].combine_chunks()
        values = lists.values.to_numpy().astype("<u4").tobytes()
        bounds = lists.offsets.to_numpy().astype(np.int64)
        # The bytes of all tokens lie one after the other, so those of a word are one stretch.
        tokens = parts.values.cast(pa.large_binary())
        places = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset:][parts.offsets.to_numpy()].tolist()
        content = tokens.buffers()[2]
        decoded = [content[a:b].to_pybytes() for a, b in zip(places, places[1:])]
        if decoded != words:
            raise ValueError("a word's tokens do not decode to it")
        bounds = (bounds * 4).tolist()
        return zip((values[a:b] for a, b in zip(bounds, bounds[1:])), decoded)


def piece_key(piece: str) -> str | tuple[str]:
    """The key of a piece that ``CUT`` gave."""
    plain = len(piece) > 1 and piece[0] == " " and not piece[1].isspace() and not piece[-1].isspace()
    return piece[1:] if plain else (piece,)


class TextCoder:
    """Documents from coded words; pieces between single spaces are remembered.

    A piece is keyed by what follows its space.  The head of a text has no space
    before it and is keyed by a tuple, and so is the punctuation that ends a piece: the pattern parts letters and digits
    from punctuation behind them.  No match of the pattern crosses a space
    after something else than white space, so a text without runs of white space
    before a space is the sequence of its pieces; any other is cut by ``CUT``, and
    its pieces are looked up likewise, all that are new in a slice by one query.
    """

    def __init__(self, rank_file: bytes, pattern: str):
        self.words, self.pattern = WordCoder(rank_file), regex.compile(pattern)
        self.memo = Memo(self._pieces, limit=300_000)

    def _matches(self, pieces: list[str]) -> list[tuple[bytes, bytes]]:
        """Of each piece its ids and what they decode to."""
        found = [self.pattern.findall(p) for p in pieces]
        distinct = list({w for words in found for w in words})
        coded = dict(zip(distinct, self.words.code([w.encode() for w in distinct])))
        return [coded[words[0]] if len(words) == 1 else together([coded[w] for w in words]) for words in found]

    def _pieces(self, keys: list) -> list[tuple]:
        """An empty value says that a text with this piece must be cut otherwise."""
        single = [k for k in keys if type(k) is tuple or k and not k[-1].isspace()]
        coded = dict(zip(single, self._matches([k[0] if type(k) is tuple else " " + k for k in single])))
        return [coded.get(k, ()) for k in keys]

    def texts(self, texts: pa.Array) -> tuple[list[bytes], list[bytes]]:
        """Ids and decoded bytes of each text of a string array without nulls."""
        split = pc.split_pattern(texts, " ")
        pieces, bounds = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = pieces.dictionary_encode()
        parts, head, tail = heads_and_tails(coded.dictionary.cast(pa.binary()))
        parts = parts.cast(pa.string()).to_pylist()
        begun = [(p,) if p else "" for p in pieces.take(pa.array(bounds[:-1])).to_pylist()]
        heads, head = np.unique(head, return_inverse=True)
        tails, tail = np.unique(tail, return_inverse=True)
        heads, tails = [parts[h] for h in heads.tolist()], [(parts[t],) if parts[t] else "" for t in tails.tolist()]
        keys = list(dict.fromkeys([*heads, *filter(None, tails), *filter(None, begun)]))
        value = dict(zip(keys, self.memo.look(keys)))
        starts = list(dict.fromkeys(filter(None, begun)))
        place = {h: len(head) + i for i, h in enumerate(starts)}

        def of_pieces(kind: int) -> pa.Array:
            """The ids (0) of each distinct piece and each beginning of a text, or what they decode to (1)."""
            first, last, whole = (
                pa.array([value[k][kind] if k and value[k] else b"" for k in some], pa.large_binary()) for some in (heads, tails, starts)
            )
            both = pc.binary_join_element_wise(first.take(pa.array(head)), last.take(pa.array(tail)), pa.scalar(b"", pa.large_binary()))
            return pa.concat_arrays([both, whole])

        number = coded.indices.to_numpy().copy()
        uncut = np.array([not k or not value[k] for k in heads], bool)[head[number]]
        number[bounds[:-1]] = [place.get(h, 0) for h in begun]
        uncut[bounds[:-1]] = [not h or h[0][-1].isspace() for h in begun]
        uncut = np.logical_or.reduceat(uncut, bounds[:-1]).tolist() if len(begun) else []
        others = {i: [piece_key(x) for x in CUT.split(texts[i].as_py())] for i, odd in enumerate(uncut) if odd}
        keys = list(dict.fromkeys(k for some in others.values() for k in some))
        known = dict(zip(keys, self.memo.look(keys)))
        out, back = (joined(of_pieces(kind), number, bounds) for kind in (0, 1))
        for i, some in others.items():
            out[i], back[i] = together([known[k] for k in some])
        return out, back


def together(coded: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
    return tuple(map(b"".join, zip(*coded))) if coded else (b"", b"")


def joined(values: pa.Array, number: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The values of the given numbers one after the other, from each bound to the next."""
    if not len(number):
        return [b""] * (len(bounds) - 1)
    taken = values.take(pa.array(number))
    data = taken.buffers()[2].to_pybytes()
    ends = np.frombuffer(taken.buffers()[1], np.int64)[bounds].tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:])]


#: What an encoded text can give: a column, its type, and how it follows from the ids (little-endian, 32 bits) and
#: the decoded bytes.
Output = tuple[str, T.DataType, Callable[[bytes, bytes], object]]

WHOLE: list[Output] = [
    ("ids", T.BinaryType(), lambda ids, decoded: ids), ("decoded", T.BinaryType(), lambda ids, decoded: decoded),
]
DIGESTS: list[Output] = [
    ("ids_sha256", T.StringType(), lambda ids, decoded: hashlib.sha256(ids).hexdigest()),
    ("decoded_sha256", T.StringType(), lambda ids, decoded: hashlib.sha256(decoded).hexdigest()),
]


def encode_decode(
    docs: DataFrame, rank_file: str, pattern: str, outputs: list[Output] = WHOLE, id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Ids of every whole text and the bytes they decode to.

    Returns the id column, ``n_tokens`` and the outputs, which are worked out where
    the text was encoded; other columns of ``docs`` are not read, whatever their names.
    """
    spark = docs.sparkSession
    content = read_ranks(rank_file)
    ranks = spark.sparkContext.broadcast(content)  # one vocabulary file, of fixed size
    key = ("bpe", hashlib.sha256(content).hexdigest(), pattern)
    names = [name for name, _, _ in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = per_worker(key, lambda: TextCoder(ranks.value, pattern))
        gc.disable()  # what a slice makes are many small values, none of which refer to each other
        try:
            for part in slices(batches, "text_", CODED_BYTES):
                ids, decoded = coder.texts(part.column("text_").cast(pa.string()))
                made = [pa.array([f(x, y) for x, y in zip(ids, decoded)], to_arrow_type(kind)) for _, kind, f in outputs]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), *made], names=[id_column, "n_tokens", *names]
                )
        finally:
            gc.enable()

    schema = out_schema(docs, [id_column], [("n_tokens", T.LongType()), *[(name, kind) for name, kind, _ in outputs]])
    return arrow_map(docs.select(id_column, as_bytes(text_column).alias("text_")), run, schema, remembers=True)
