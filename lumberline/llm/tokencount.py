"""Exact token counts of every prefix, by dynamic programming over byte-pair merges.

The encoding of a string ends in exactly one token t such that the encoding of what is
before t, followed by t, has no merge across the seam. So the last token and the count
of each prefix follow from those of shorter prefixes, and no string is encoded twice.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumberline.llm.tokens import Memo, Splitter, as_byte_letters, vocabulary_text
from lumberline.llm.words import lean

NEVER = 1 << 60
PAIR_MEMO = 1_000_000


class PrefixCounter:
    """Counts for the words of one vocabulary."""

    def __init__(self, vocabulary: str):
        self.splitter = Splitter(vocabulary)
        model = self.splitter.model
        self.end = model.get("end_of_word_suffix") or ""
        self.longest = max(len(t.removesuffix(self.end)) for t in model["vocab"])
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: r for r, m in enumerate(merges)}
        self.parts = {a + b: (a, b) for a, b in reversed(merges)}
        self.spines: dict[tuple[str, int], list[tuple[str, int, int]]] = {}
        self.seams: dict[tuple[str, str], bool] = {}
        self.reach: dict[str, bool] = {}
        self.tokens = {t for t in model["vocab"] if self.reachable(t)}
        self.words = Memo(self.word)

    def spine(self, token: str, side: int) -> list[tuple[str, int, int]]:
        """The parts of a token at one of its ends: (part, rank that made it, rank that used it up)."""
        if (out := self.spines.get((token, side))) is None:
            out, part, dies = [], token, NEVER
            while True:
                halves = self.parts.get(part)
                born = self.rank[halves] if halves else -1
                out.append((part, born, dies))
                if not halves:
                    break
                part, dies = halves[side], born
            self.spines[token, side] = out
        return out

    def crossed(self, a: str, b: str, below: int = NEVER) -> bool:
        """Whether a merge (of a rank under ``below``) joins an end of a with a beginning of b."""
        for left, born_l, dies_l in self.spine(a, 1):
            for right, born_r, dies_r in self.spine(b, 0):
                if (r := self.rank.get((left, right))) is not None and r < below:
                    # Of equal ranks the leftmost pair is merged first.
                    if r < dies_l and r <= dies_r and born_l <= dies_r and born_r < dies_l:
                        return True
        return False

    def reachable(self, token: str) -> bool:
        """Whether the token is its own encoding."""
        if (out := self.reach.get(token)) is None:
            halves = self.parts.get(token)
            out = not halves or (
                self.reachable(halves[0]) and self.reachable(halves[1]) and not self.crossed(*halves, self.rank[halves])
            )
            self.reach[token] = out
        return out

    def fits(self, a: str, b: str) -> bool:
        if len(self.seams) >= PAIR_MEMO:
            self.seams.clear()
        out = self.seams[a, b] = not self.crossed(a, b)
        return out

    def step(self, word: str, to: int, counts: list[int], last: list[str], ending: str) -> tuple[int, str]:
        """Count and last token of word[:to], given those of all shorter prefixes without an end mark."""
        tokens, seams = self.tokens, self.seams
        for at in range(max(0, to - self.longest), to):
            token = word[at:to] + ending
            if token in tokens:
                if not at:
                    return 1, token
                seam = last[at], token
                if seams[seam] if seam in seams else self.fits(*seam):
                    return counts[at] + 1, token
        raise ValueError(f"no encoding for {word[:to]!r}")

    def open_prefixes(self, word: str, size: int) -> tuple[list[int], list[str]]:
        """Count and last token of each prefix up to ``size`` letters, the word going on after it."""
        tokens, seams, longest = self.tokens, self.seams, self.longest
        counts, last = [0], [""]
        for to in range(1, size + 1):
            for at in range(to - longest if to > longest else 0, to):
                token = word[at:to]
                if token in tokens:
                    if not at:
                        break
                    seam = last[at], token
                    if seams[seam] if seam in seams else self.fits(*seam):
                        break
            else:
                raise ValueError(f"no encoding for {word[:to]!r}")
            counts.append(counts[at] + 1)
            last.append(token)
        return counts, last

    def word(self, pretoken: str) -> int:
        """Tokens of a whole pre-token."""
        word = as_byte_letters(pretoken)
        if word + self.end in self.tokens:
            return 1
        counts, last = self.open_prefixes(word, len(word) - 1)
        return self.step(word, len(word), counts, last, self.end)[0]

    def prefixes(self, pretoken: str) -> list[int]:
        """Tokens of each prefix of a pre-token, by number of characters, from 0."""
        word = as_byte_letters(pretoken)
        counts, last = self.open_prefixes(word, len(word) - 1)
        out, to = [0], 0
        for c in pretoken:
            to += len(c.encode())
            out.append(self.step(word, to, counts, last, self.end)[0])
        return out

    def chunk(self, chunk: bytes) -> int:
        words, text = self.words, chunk.decode()
        plain = self.splitter.normal(text)
        if at := self.splitter.tail(plain):
            return words[plain] if at == len(plain) else words[plain[:at]] + words[plain[at:]]
        return sum([1 if isinstance(x, int) else words[x] for x in self.splitter.pretokens(text)])

    def table(self, text: str) -> list[int]:
        """Tokens of text[:i] for every i from 0 to its length."""
        out, total = [0], 0
        for chunk in _chunks(text):
            if chunk[0] in _WHITE:
                out += [total] * len(chunk)
                continue
            inner = self._chunk_table(chunk)
            out += [total + n for n in inner[1:]]
            total += inner[-1]
        return out

    def _chunk_table(self, chunk: str) -> list[int]:
        plain = self.splitter.normal(chunk)
        if "'" in chunk or "<" in chunk or len(plain) != len(chunk) or not chunk.isascii() and plain != "".join(map(str.lower, chunk)):
            # A prefix may split or compose in another way than the whole: each on its own.
            return [self.chunk(chunk[:i].encode()) for i in range(len(chunk) + 1)]
        out, total, at = [0], 0, 0
        for found in self.splitter.words.finditer(plain):
            out += [total] * (found.start() - at)
            inner = self.prefixes(found[0])
            out += [total + n for n in inner[1:]]
            total, at = total + inner[-1], found.end()
        return out + [total] * (len(plain) - at)


# The white space at which bytes.split() splits.
_WHITE = " \t\n\r\x0b\x0c"


def _chunks(text: str) -> Iterator[str]:
    """Runs of white space and runs of other characters, in order."""
    at = 0
    while at < len(text):
        white, to = text[at] in _WHITE, at + 1
        while to < len(text) and (text[to] in _WHITE) == white:
            to += 1
        yield text[at:to]
        at = to


@lru_cache(2)
def counter(vocabulary: str) -> tuple[PrefixCounter, Memo]:
    c = PrefixCounter(vocabulary)
    return c, Memo(c.chunk)


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of each whole text; NULL and empty texts have 0 of both.

    Other columns are not carried; repeated rows stay repeated.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary_text(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = counter(sent.value)[1].__getitem__
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            n_bytes = pa.array([len(t or b"") for t in texts], pa.int64())
            n_tokens = pa.array([sum(map(look, (t or b"").split())) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n_tokens], ["doc_id", "n_bytes", "n_tokens"])

    picked = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return picked.mapInArrow(lean(count), "doc_id bigint, n_bytes bigint, n_tokens bigint")


def prefix_table(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, counts``: the tokens of text[:i] for every i; a NULL text has counts [0]."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary_text(path))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counter(sent.value)[0].table
        for batch in batches:
            for i in range(batch.num_rows):  # a row each: a table is four times its text
                counts = pa.array([table(batch.column(1)[i].as_py() or "")], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), counts], ["doc_id", "counts"])

    picked = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return picked.mapInArrow(lean(tables), "doc_id bigint, counts array<int>")


def longest_prefix(counts: np.ndarray | list[int], budget: int) -> int:
    """Characters of the longest prefix up to which no prefix has more than ``budget`` tokens."""
    return bisect_right(np.maximum.accumulate(counts), budget) - 1


def truncated(docs: DataFrame, path: str, budget: int) -> DataFrame:
    """``doc_id, text, n_tokens``: each text cut to its longest prefix within ``budget`` tokens; NULL is empty."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary_text(path))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counter(sent.value)[0].table
        for batch in batches:
            texts, numbers = [], []
            for text in batch.column(1).to_pylist():
                counts = table(text or "")
                n = longest_prefix(counts, budget)
                texts.append((text or "")[:n])
                numbers.append(counts[n])
            arrays = [batch.column(0), pa.array(texts, pa.string()), pa.array(numbers, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text", "n_tokens"])

    picked = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return picked.mapInArrow(lean(cut), "doc_id bigint, text string, n_tokens bigint")
