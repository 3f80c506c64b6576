"""Pre-tokens of a word-level byte-pair vocabulary (a ``tokenizers`` JSON file).

The file's rules (NFC, lower case, white space dropped, a split pattern, byte letters)
never look across white space, so a text is its white-space separated chunks, and a
chunk's tokens can be remembered.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache
from string import punctuation as PUNCTUATION
from unicodedata import is_normalized, normalize

import regex
from tokenizers import Tokenizer

# Chunks remembered by one Python worker in each of two generations (bounded memory).
MEMO_SIZE = 400_000


def vocabulary_text(path: str) -> str:
    """The vocabulary file, read on the driver to be sent to the tasks (1.7 MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


@lru_cache(1)
def byte_letters() -> list[str]:
    """The letter of each byte: printable bytes are themselves, the others follow from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class Splitter:
    """Chunks into pre-tokens; special strings become their ids."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        self.model = spec["model"]
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    @staticmethod
    def normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        if not is_normalized("NFC", text):
            text = normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(map(str.lower, text))  # no final-sigma rule

    @staticmethod
    def tail(plain: str) -> int:
        """Where the punctuation behind a normal chunk's letters begins; 0 if it is not letters and punctuation."""
        body = plain.rstrip(PUNCTUATION)
        return len(body) if body.isalpha() else 0

    def pretokens(self, chunk: str) -> list[str | int]:
        if self.at_special is None or "<" not in chunk:
            return self.words.findall(self.normal(chunk))
        out: list[str | int] = []
        for part in self.at_special.split(chunk):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.words.findall(self.normal(part))
        return out


def as_byte_letters(pretoken: str) -> str:
    if pretoken.isascii() and pretoken.isprintable():
        return pretoken
    letters = byte_letters()
    return "".join([letters[b] for b in pretoken.encode()])


class Memo(dict):
    """What a function gave for each chunk so far.

    When this generation is full it becomes the older one, and what was the older one is
    forgotten; a chunk met again comes back from the older one. So frequent chunks stay.
    """

    def __init__(self, of: Callable, size: int = MEMO_SIZE):
        super().__init__()
        self.of, self.size, self.older = of, size, {}

    def __missing__(self, chunk):
        value = self.older.get(chunk)
        if value is None:
            value = self.of(chunk)
        if len(chunk) <= 64:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[chunk] = value
        return value


@lru_cache(2)
def id_bytes(vocabulary: str) -> Memo:
    """chunk -> its token ids as little-endian unsigned 32-bit numbers."""
    split = Splitter(vocabulary)
    tokenize = Tokenizer.from_str(vocabulary).model.tokenize

    def word(pretoken: str) -> bytes:
        return b"".join([t.id.to_bytes(4, "little") for t in tokenize(as_byte_letters(pretoken))])

    def of(chunk: bytes) -> bytes:
        text = chunk.decode()
        plain = split.normal(text)
        at = split.tail(plain)
        if at == len(plain):
            return word(plain) if plain == text else memo[plain.encode()]
        if at:
            return memo[plain[:at].encode()] + memo[plain[at:].encode()]
        out = b""
        for x in split.pretokens(text):
            out += x.to_bytes(4, "little") if isinstance(x, int) else memo[x.encode()] if x.isalpha() else word(x)
        return out

    memo = Memo(of)
    return memo
