"""Byte-level byte-pair encoding and decoding with a public vocabulary (a ``tokenizers`` JSON file).

A pre-token is a doubly linked list of symbols. Its mergeable pairs wait in a priority
queue by rank, then by place; an entry whose symbols have changed since is stale and
skipped. Decoding concatenates the vocabulary's strings.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise
from string import punctuation as PUNCTUATION

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumberline.llm.tokens import Memo, byte_letters, vocabulary_text
from lumberline.llm.words import lean

MEMO_SIZE = 250_000  # words, and chunks, remembered in each of two generations
FLUSH_BYTES = 1 << 22  # ids or texts in one Arrow batch, or one row
# Fixed value: how the byte-level rule splits a text.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
WORDS = regex.compile(PATTERN)
# A coarser split with the same borders around white space.
CHUNKS = regex.compile(r" ?\P{White_Space}+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
# Fixed value: the characters of White_Space.
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


class Codec:
    """Encoding and decoding with one vocabulary."""

    def __init__(self, vocabulary: str, size: int = MEMO_SIZE):
        spec = json.loads(vocabulary)
        model, before = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("not a plain byte-level vocabulary")
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.pairs = [(vocab[a], vocab[b]) for a, b in merges]
        self.made = [vocab[a + b] for a, b in merges]
        self.rank = {pair: r for r, pair in reversed([*enumerate(self.pairs)])}
        letters = byte_letters()
        self.of_byte = [vocab[letters[b]] for b in range(256)]
        byte_of = {c: b for b, c in enumerate(letters)}
        strings = {i: bytes([byte_of[c] for c in token]) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings |= {i: content.encode() for content, i in self.special.items()}
        self.strings = [strings.get(i, b"") for i in range(max(strings) + 1)]
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        # Ids of chunks as little-endian bytes: as they stand, and with a space before them.
        self.words = Memo(lambda word: _as_bytes(self.merged(word.encode())), size)
        self.plain, self.spaced = Memo(self.chunk, size), Memo(self.behind_space, size)

    def merged(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        rank, pairs, made = self.rank.get, self.pairs, self.made
        symbols = [self.of_byte[b] for b in word]
        size = len(symbols)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        # An entry is a rank (which names a pair) and the place of the pair's left symbol.
        queue = [r << 32 | at for at, pair in enumerate(pairwise(symbols)) if (r := rank(pair)) is not None]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            r, at = entry >> 32, entry & 0xFFFFFFFF
            left, right = pairs[r]
            to = after[at]
            if symbols[at] != left or to >= size or symbols[to] != right:
                continue  # stale: one of the two was merged meanwhile
            symbols[at], symbols[to] = made[r], -1
            new = symbols[at]
            after[at] = end = after[to]
            if end < size:
                before[end] = at
                if (r := rank((new, symbols[end]))) is not None:
                    heappush(queue, r << 32 | at)
            if (start := before[at]) >= 0 and (r := rank((symbols[start], new))) is not None:
                heappush(queue, r << 32 | start)
        return [s for s in symbols if s >= 0]

    def chunk(self, chunk: str) -> bytes:
        """Ids of a piece of text that no pre-token leaves."""
        words = self.words
        return b"".join([words[word] for word in WORDS.findall(chunk)])

    def behind_space(self, chunk: str) -> bytes | None:
        """Ids of a space and ``chunk``; None where they depend on what is around them."""
        words = self.words
        if chunk.isalpha():
            return words[" " + chunk]
        body = chunk.rstrip(PUNCTUATION)
        if body.isalpha():
            return words[" " + body] + words[chunk[len(body) :]]
        if not chunk or chunk[0] in WHITE or chunk[-1] in WHITE:
            return None
        return self.chunk(" " + chunk)

    def _encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if first and first[0] not in WHITE and first[-1] not in WHITE:
            try:
                return self.plain[first] + b"".join(map(self.spaced.__getitem__, rest))
            except TypeError:
                pass  # several spaces in a row, or other white space at a space
        return b"".join(map(self.plain.__getitem__, CHUNKS.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, little-endian unsigned 32-bit; special strings become their ids."""
        if self.at_special is None or not self.at_special.search(text):
            return self._encode(text)
        parts = self.at_special.split(text)
        return b"".join([_as_bytes([self.special[x]]) if x in self.special else self._encode(x) for x in parts])

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD, unknown ids nothing."""
        strings = self.strings
        numbers = memoryview(ids).cast("I")
        try:
            joined = b"".join([strings[i] for i in numbers])
        except IndexError:
            joined = b"".join([strings[i] for i in numbers if i < len(strings)])
        return joined.decode("utf-8", "replace")


def _as_bytes(ids: list[int]) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


@lru_cache(2)
def codec(vocabulary: str) -> Codec:
    return Codec(vocabulary)


def _in_parts(rows: Iterator[tuple], kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows whose last value is bytes or text, as batches of a bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= FLUSH_BYTES:
            yield _batch(held, kinds, names)
            held, size = [], 0
    if held:
        yield _batch(held, kinds, names)


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` of each whole text; ids are little-endian unsigned 32-bit numbers.

    NULL and empty texts have no ids. Repeated rows stay repeated, other columns are not
    carried, an empty table gives an empty table. A text is held whole in one task.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary_text(path))  # 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(sent.value).encode
        for batch in batches:
            rows = ((i.as_py(), of(t.as_py() or "")) for i, t in zip(batch.column(0), batch.column(1), strict=True))
            yield from _in_parts(rows, [pa.int64(), pa.binary()], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id bigint, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, text``: the text of each row's ids; NULL ids are an empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary_text(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(sent.value).decode
        for batch in batches:
            pairs = ((i.as_py(), x.as_py()) for i, x in zip(batch.column(0), batch.column(1), strict=True))
            rows = ((i, x, of(x or b"")) for i, x in pairs)
            yield from _in_parts(rows, [pa.int64(), pa.binary(), pa.string()], ["doc_id", "ids", "text"])

    picked = encoded.select(F.col("doc_id").cast("bigint"), F.col("ids").cast("binary"))
    return picked.mapInArrow(lean(run), "doc_id bigint, ids binary, text string")
