"""BPE encoding and decoding by dynamic programming over the prefixes of a word."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyspark.llm.vocab import Splitter, WordCache, byte_letters, load, lowered, special_splitter

_PAIRS = 1 << 20


class PrefixCodec:
    """Encoder and decoder of a word-level BPE file.

    The encoding of a prefix of a word is the encoding of a shorter prefix plus one last token, and that last
    token is unique. An automaton over the vocabulary gives the tokens that end at each place; the one that is
    compatible with the last token of the prefix before it is stored. Back-pointers then give the ids.

    Symbols: chr(b) for byte b inside a word, chr(256 + b) for the byte that ends it.
    """

    def __init__(self, path: str):
        spec = load(path)
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.text = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ends = bool(suffix)
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        spelled: dict[int, str] = {}
        for byte, letter in enumerate(byte_letters()):
            spelled[vocab[letter]] = chr(byte)
            if suffix:
                spelled[vocab[letter + suffix]] = chr(256 + byte)
        for rank, (left, right) in enumerate(model["merges"]):
            whole = vocab[left + right]
            a, b = vocab[left], vocab[right]
            self.merged.setdefault((a, b), rank)
            if whole not in self.halves:
                self.rank[whole], self.halves[whole] = rank, (a, b)
                spelled[whole] = spelled[a] + spelled[b]
        self.length = {token: len(s) for token, s in spelled.items()}
        self.matches = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, s in spelled.items():
            if self._reachable(token):
                self.matches.add_word(s, token)
        self.matches.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.special = special_splitter(spec)
        self.words = Splitter(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cache = WordCache(self._word)

    def _reachable(self, token: int) -> bool:
        """Whether merging the token's own symbols makes it: its halves are, and nothing merges across them earlier."""
        halves = self.halves.get(token)
        return halves is None or self._compatible(*halves, before=self.rank[token])

    def _compatible(self, left: int, right: int, before: int | None = None) -> bool:
        """Whether both tokens stay apart when their joined symbols are merged.

        Goes back in time along the seam: the half merged last is taken apart, the right one if both have the
        same rank because merging goes from left to right. If at any moment the two symbols at the seam form a
        pair that would have been merged before that half was, the seam does not hold. `before` only looks at
        pairs of lower rank than that merge.
        """
        bound = before if before is not None else len(self.merged) + 1
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < bound:
                return False
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                bound, left = min(bound, a), self.halves[left][1]
            else:
                bound, right = min(bound, b + 1), self.halves[right][0]

    def encode_symbols(self, symbols: str) -> list[int]:
        n = len(symbols)
        last = [-1] * n
        length, fits = self.length, self.fits
        for end, token in self.matches.iter(symbols):
            if last[end] >= 0:
                continue
            start = end - length[token]
            if start >= 0:
                pair = (last[start], token)
                good = fits.get(pair)
                if good is None:
                    if len(fits) >= _PAIRS:
                        fits.clear()
                    good = fits[pair] = self._compatible(*pair)
                if not good:
                    continue
            last[end] = token
        ids = []
        at = n - 1
        while at >= 0:
            ids.append(last[at])
            at -= length[last[at]]
        ids.reverse()
        return ids

    def encode_word(self, word: str) -> list[int]:
        symbols = word.encode("utf-8").decode("latin-1")
        if self.ends:
            symbols = symbols[:-1] + chr(256 + ord(symbols[-1]))
        return self.encode_symbols(symbols)

    def _word(self, word: str) -> tuple[bytes, str]:
        ids = self.encode_word(word)
        return struct.pack(f"<{len(ids)}I", *ids), self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        """Token texts with a blank between them, special ones included: the file has no decoder."""
        return " ".join([self.text[i] for i in ids])

    def parts(self, text: str) -> list[tuple[bytes, str]]:
        """Ids (little-endian unsigned 32-bit) and decoded text of each word, in order."""
        out: list[tuple[bytes, str]] = []
        for i, part in enumerate(self.special.split(text) if self.special else [text]):
            if i % 2:
                out.append((struct.pack("<I", self.added[part]), part))
            elif part:
                out.extend(map(self.cache.__getitem__, self.words(lowered(part))))
        return out

    def encode(self, text: str) -> list[int]:
        packed = b"".join([ids for ids, _ in self.parts(text)])
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))


@lru_cache(maxsize=2)
def codec(path: str) -> PrefixCodec:
    return PrefixCodec(path)


def encode_documents(
    docs: DataFrame, tokenizer: str, *, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, unless told otherwise, ids and decoded of every row's text.

    `tokenizer` is the path of a BPE file with word ends and lower case, in the format of the tokenizers
    library. Digests are of the ids as little-endian unsigned 32-bit integers and of the decoded text in
    UTF-8. Null and empty texts have no tokens and decode to an empty text. Repeated rows and null identifiers
    pass through; other columns are not read.

    Rows never move. A worker keeps the result of a bounded number of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = codec(tokenizer).parts
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for text in batch.column(1).to_pylist():
                parts = split(text or "")
                ids, decoded = b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts])
                row = (
                    len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest(),
                    struct.unpack(f"<{len(ids) // 4}I", ids) if with_ids else None, decoded if with_ids else None)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string())
            arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            used = 6 if with_ids else 4
            yield pa.RecordBatch.from_arrays(arrays[:used], names[:used])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, text_col).mapInArrow(run, schema + (", ids array<int>, decoded string" if with_ids else ""))
