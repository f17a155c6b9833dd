"""What the byte-pair operators share: tokenizer files, byte symbols, splitting into words, a bounded word cache."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import regex
from tokenizers import Regex
from tokenizers.normalizers import NFC, Lowercase
from tokenizers.pre_tokenizers import Split

# How byte-level tokenizers split text into words when the file only says "use_regex".
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same split without backtracking over long runs.
BYTE_LEVEL_POSSESSIVE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

CACHED_WORDS = 1 << 19
CACHED_LENGTH = 48


@lru_cache(maxsize=4)
def load(path: str) -> dict:
    """The tokenizer file. Read by each Python worker once; it lies at the same path on every machine."""
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def special_splitter(spec: dict) -> regex.Pattern | None:
    """Finds the added tokens, which are taken out of the text before anything else; of two at one place, the longer."""
    names = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
    return regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None


class WordCache(dict):
    """Results per word, computed on a miss. Emptied when full, so memory stays bounded; long words are not kept."""

    def __init__(self, make: Callable[[str], object], limit: int = CACHED_WORDS):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word: str):
        value = self.make(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value


_BEYOND = re.compile("[^\0-\u0377]")


def is_newer(text: str) -> bool:
    """Whether the text has code points that this Python's Unicode tables do not know."""
    return bool(_BEYOND.search(text)) and any(unicodedata.category(c) == "Cn" for c in set(text))


class Splitter:
    """Splits text into the matches of a tokenizer file's pattern.

    Unicode versions differ in which newer code points are letters, so texts with such are split by the
    tokenizers library itself.
    """

    def __init__(self, pattern: str):
        self.find = regex.compile(pattern).findall
        self.exact = Split(Regex(pattern), "removed", invert=True)

    def __call__(self, text: str) -> list[str]:
        if is_newer(text):
            return [word for word, _ in self.exact.pre_tokenize_str(text)]
        return self.find(text)


def lowered(text: str) -> str:
    """NFC in lower case, letter by letter, so that a final sigma is no exception."""
    if is_newer(text):
        return Lowercase().normalize_str(NFC().normalize_str(text))
    return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
