"""Periodic runs of words: recursive frequency splitting, then a lag scan of the stretches that survive.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), at least
max(6, 4 q) words long, that neither neighbouring word extends with period q. Every word inside such a run
occurs at least four times in it (once for each of its at least four periods), so a word seen fewer than four
times in a stretch cannot lie in a run inside that stretch: it splits the stretch. Splitting repeats on the
pieces until every word of a piece occurs four times in it; runs never cross a split, and a run that is
maximal in its piece is maximal in the text. Only the surviving pieces are scanned, lag by lag.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# A run holds at least this many words, and at least this many periods.
SHORTEST = 6
PERIODS = 4


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: pieces between the blanks space, tab, LF, VT, FF and CR (bytes.split splits at these)."""
    return text.encode("utf-8").split() if text else []


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words after the contract's planted repetition; a null identifier plants nothing.

    h = unsigned crc32 of the decimal identifier, g = h // 10. If h % 10 == 0 and there are n > 0 words, each
    word i >= a becomes word a + (i - a) % p, where a = g % n and p = 1 + (n - a) // (3 + g % 8).
    """
    n = len(words)
    if doc_id is None or n == 0:
        return words
    h = zlib.crc32(str(doc_id).encode("ascii"))
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def surviving(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches [start, end) that may hold runs: words seen fewer than four times split their stretch, to stability."""
    out, todo = [], [(0, len(ids))]
    while todo:
        start, end = todo.pop()
        if end - start < SHORTEST:
            continue
        piece = ids[start:end]
        _, where, counts = np.unique(piece, return_inverse=True, return_counts=True)
        rare = np.flatnonzero(counts[where] < PERIODS)
        if not len(rare):
            out.append((start, end))
            continue
        edges = np.concatenate(([-1], rare, [len(piece)]))
        todo.extend((start + a + 1, start + b) for a, b in zip(edges[:-1], edges[1:]) if b - a - 1 >= SHORTEST)
    return sorted(out)


@lru_cache(maxsize=4096)
def _prime_factors(q: int) -> tuple[int, ...]:
    out, d = [], 2
    while d * d <= q:
        if q % d == 0:
            out.append(d)
            while q % d == 0:
                q //= d
        d += 1
    if q > 1:
        out.append(q)
    return tuple(out)


def _primitive(piece: np.ndarray, q: int) -> bool:
    """Whether the smallest period of a piece with period q and at least 2 q words is q.

    A smaller period p would give period gcd(p, q) (Fine and Wilf), a proper divisor of q, hence one of q / prime.
    """
    return not any(np.array_equal(piece[: len(piece) - q // f], piece[q // f :]) for f in _prime_factors(q))


def runs_in(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of word numbers, by start, then period."""
    found = []
    for start, end in surviving(ids):
        piece = ids[start:end]
        m = end - start
        for q in range(1, m // PERIODS + 1):
            need = max(SHORTEST - q, (PERIODS - 1) * q)  # equal pairs q apart that a run of period q holds
            same = piece[:-q] == piece[q:]
            if int(np.count_nonzero(same)) < need:
                continue
            steps = np.diff(np.concatenate(([0], same.view(np.int8), [0])))
            opens, shuts = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
            for a, b in zip(opens.tolist(), shuts.tolist()):
                if b - a >= need and _primitive(piece[a : b + q], q):
                    found.append((start + a, b - a + q, q))
    found.sort(key=lambda r: (r[0], r[2]))
    return found


def periodic_runs(words: list[bytes]) -> tuple[list[tuple[int, int, int]], list[bytes]]:
    """Runs of a word list and the words that stay: a word goes when a run holds it after that run's first period."""
    if not words:
        return [], []
    _, ids = np.unique(np.array(words, dtype=object), return_inverse=True)
    runs = runs_in(ids.astype(np.int64))
    mark = np.zeros(len(words) + 1, np.int32)
    for start, length, period in runs:
        mark[start + period] += 1
        mark[start + length] -= 1
    gone = np.cumsum(mark[:-1]) > 0
    return runs, [w for w, g in zip(words, gone.tolist()) if not g]


def _longest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    return min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)


RESULT = (
    "n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs array<struct<start:long,length:long,period:long>>, collapsed string")


def find_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """Periodic runs of the words of every row's whole text, and the text collapsed to the words that stay.

    Returns the identifier column, n_words, n_runs, the longest run's start, length, period and exponent_milli
    (floor(1000 length / period); ties: smallest start, then period; all null without runs), runs (every run,
    by start, then period) and collapsed (words that stay, joined by one space). With `plant`, the contract's
    planted repetition is applied first (see `planted`; the identifier must be an integer).

    A null or blank text has no words, no runs and an empty collapsed text. Repeated rows and null identifiers
    pass through, each row on its own; other columns are not read. A very long text costs its words times the
    lags of its surviving stretches, in one task; rows never move.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cols: dict[str, list] = {k: [] for k in ("n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed")}
            for key, text in zip(keys, texts):
                words = words_of(text)
                if plant:
                    words = planted(words, key)
                runs, kept = periodic_runs(words)
                best = _longest(runs)
                cols["n_words"].append(len(words))
                cols["n_runs"].append(len(runs))
                for name, value in zip(("start", "length", "period"), best or (None, None, None)):
                    cols[name].append(value)
                cols["exponent_milli"].append(best and 1000 * best[1] // best[2])
                cols["runs"].append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                cols["collapsed"].append(b" ".join(kept).decode("utf-8"))
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), **cols}, schema=schema)

    schema = pa.schema([
        pa.field(id_col, batch_type(kind)), *(pa.field(n, pa.int64()) for n in ("n_words", "n_runs", "start", "length", "period", "exponent_milli")),
        pa.field("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
        pa.field("collapsed", pa.string()),
    ])
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, {RESULT}")


def batch_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "smallint": pa.int16()}[kind]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()
