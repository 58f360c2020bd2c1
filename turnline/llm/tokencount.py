"""Token counts of whole texts, huge documents by overlapping chunks spliced at proven boundaries.

A document of at most ``chunk`` characters is encoded piece by piece: the
tokenizer drops white space and no token spans it, so the tokens of a text are
those of its pieces between ASCII white space, and pieces are remembered.

A longer document is encoded in overlapping chunks with offsets.  The encoder
scans from left to right and what it does from a word start on depends only on
the text from there; so a word start that follows ASCII white space and appears
in the encodings of both neighbouring chunks is a proven boundary: left of it
the left chunk is right, from it on the right chunk is.  Two chunks without such
a start in their overlap are encoded again with twice the overlap, in the end as
one piece.  Memory holds one document and one chunk.

Null counts as empty: 0 bytes, 0 tokens.  Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from turnline.llm.common import Memo, arrow_map, as_bytes, heads_and_tails, numbered_words, out_schema, per_worker, slices

#: Characters of a chunk, and of the overlap to begin with.
CHUNK, OVERLAP = 32_768, 512

WHITE = " \t\n\r\x0b\x0c"


def load_tokenizer(content: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(content)


def read_text(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def word_starts(text: str, at: int, encoding, low: int, high: int) -> dict[int, int]:
    """Places in [low, high) where a word starts after white space, each with the number of tokens before it."""
    found, words = {}, encoding.word_ids
    for i, (a, _) in enumerate(encoding.offsets):
        place = a + at
        if place >= high:
            break
        if place >= low and place > 0 and text[place - 1] in WHITE and (i == 0 or words[i] != words[i - 1]):
            found.setdefault(place, i)
    return found


def encode_huge(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Ids of the text, as if encoded whole."""

    def encode(a: int, b: int):
        return tokenizer.encode(text[a:b], add_special_tokens=False)

    ids: list[int] = []
    at, end = 0, min(chunk, len(text))  # the chunk at hand
    left, skip = encode(at, end), 0  # its encoding, and its tokens that the chunk before has given
    while end < len(text):
        width, spliced = overlap, False
        while width < end - at and not spliced:
            begin, stop = end - width, min(len(text), end - width + max(chunk, 2 * width))
            right = encode(begin, stop)
            ours, theirs = word_starts(text, at, left, begin, end), word_starts(text, begin, right, begin, end)
            common = [p for p in ours if p in theirs and ours[p] >= skip]
            if common:
                place = common[-1]
                ids += left.ids[skip : ours[place]]
                at, end, left, skip, spliced = begin, stop, right, theirs[place], True
            width *= 2
        if not spliced:
            # No overlap within the chunk is enough: make the chunk itself longer, from the last proven boundary on.
            end = min(len(text), at + 2 * (end - at))
            left = encode(at, end)
    return ids + left.ids[skip:]


class PieceCoder:
    """Ids of texts by their pieces between ASCII white space, as little-endian 16-bit numbers per piece.

    A piece's head and the punctuation that ends it are remembered apart: the tokenizer always parts them.
    """

    def __init__(self, content: str):
        self.tokenizer = load_tokenizer(content)
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        ends = {i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")}
        self.ends = np.array([i in ends for i in range(1 << 16)])
        self.memo = Memo(self._encode, limit=650_000, limit_bytes=32 << 20)

    def _encode(self, parts: list[bytes]) -> list[bytes]:
        words = [p.decode() for p in parts]
        plain = list(map(str.isalpha, words))
        letters = iter(self._encode_letters(list(compress(words, plain))))
        others = iter(self._encode_each([w for w, alone in zip(words, plain) if not alone]))
        return [next(letters) if alone else next(others) for alone in plain]

    def _encode_each(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, "<u2").tobytes() for e in found]

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        """Words of letters in one text: each gives one word end at least, so as many ends as words part them."""
        if not words:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u2")
        ends = (2 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(ends) != len(words):
            return self._encode_each(words)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def _placed(self, texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, dict[int, bytes]]:
        """The ids of the distinct pieces and their numbers of ids, the number of each piece in turn, where each text
        begins in ids, and the ids of the texts that hold a special string."""
        # The tokenizer lower-cases; doing it early for A-Z saves pieces, but must not make a special string.
        low = pc.ascii_lower(texts.view(pa.string()))
        special = pc.match_substring(low, os.path.commonprefix(self.special)).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(special).tolist():
            special[i] = any(s in low[i].as_py() for s in self.special)
        distinct, number, bounds = numbered_words(texts)
        parts, head, tail = heads_and_tails(distinct)
        found = self.memo.look(parts.to_pylist())
        ids = [found[h] + found[t] for h, t in zip(head.tolist(), tail.tolist())]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        ends = np.r_[0, np.cumsum(sizes[number])][bounds]
        whole = {i: self._encode_each([texts[i].as_py().decode()])[0] for i in np.flatnonzero(special).tolist()}
        return ids, sizes, number, ends, whole

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Of each text its ids."""
        ids, sizes, number, ends, whole = self._placed(texts)
        flat, starts = np.frombuffer(b"".join(ids), "<u2"), np.cumsum(sizes) - sizes
        counts = sizes[number]
        shift = (starts[number] - (np.cumsum(counts) - counts)).astype(np.int32)
        data = flat[np.repeat(shift, counts) + np.arange(counts.sum(), dtype=np.int32)].tobytes()
        at = (2 * ends).tolist()
        return [whole.get(i, data[a:b]) for i, (a, b) in enumerate(zip(at, at[1:]))]

    def counts(self, texts: pa.Array) -> list[int]:
        _, _, _, ends, whole = self._placed(texts)
        return [len(whole[i]) // 2 if i in whole else n for i, n in enumerate(np.diff(ends).tolist())]


def count_tokens(
    docs: DataFrame, tokenizer_file: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """The id column, ``n_bytes``, ``n_tokens`` and ``over_limit``; other columns are not read."""
    content = read_text(tokenizer_file)
    shared = docs.sparkSession.sparkContext.broadcast(content)  # one tokenizer file, of fixed size
    key = ("pieces", hashlib.sha256(content.encode()).hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = per_worker(key, lambda: PieceCoder(shared.value))
        for part in slices(batches, "text_", 12 << 20):
            texts = part.column("text_")
            sizes = pc.binary_length(texts).to_numpy()
            counts = np.zeros(len(texts), np.int64)
            huge = pc.greater(pc.utf8_length(texts.view(pa.string())), chunk).to_numpy(zero_copy_only=False)
            counts[~huge] = coder.counts(texts.filter(pa.array(~huge)))
            for i in np.flatnonzero(huge).tolist():
                counts[i] = len(encode_huge(coder.tokenizer, texts[i].as_py().decode(), chunk, overlap))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes.astype(np.int64)), pa.array(counts), pa.array(counts > limit)],
                names=[id_column, "n_bytes", "n_tokens", "over_limit"],
            )

    schema = out_schema(
        docs, [id_column], [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())]
    )
    return arrow_map(docs.select(id_column, as_bytes(text_column).alias("text_")), run, schema, remembers=True)
