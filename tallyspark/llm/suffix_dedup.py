"""Removal of byte strings that occur more than once, by refining buckets of sampled suffixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import small, stored, text_of, with_row
from tallyspark.llm.hashing import mix, prefix_sums, span_hashes

_K = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 24) - 1)
_BUFFER = 1 << 20
CELL = 16
DOUBLINGS = 3

# A cell is a run of windows [lo, hi] of one document that belong to one anchor.
CELLS = "_row long, anchor int, lo int, hi int, last int, n long, own boolean, core long, whole long"


class Buckets:
    """Bucket identifiers of every suffix of a buffer.

    `gram[p]` names the first q bytes of suffix p. Each doubling names twice as many bytes by the pair of the
    identifiers at p and at the later offset p + h, so after the last one `window[p]` names `length` bytes.
    """

    def __init__(self, data: np.ndarray, length: int):
        self.q = length >> DOUBLINGS
        self.sums = prefix_sums(data)
        at = np.arange(max(0, len(data) - self.q + 1))
        self.gram = names = span_hashes(self.sums, at, at + self.q)
        span = self.q
        while span < length:
            names = mix(names[: max(0, len(names) - span)] * _K + names[span:])
            span *= 2
        self.window = names


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each run of `width` values."""
    filled = np.concatenate([values, np.full(-len(values) % width, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(filled, axis=1).ravel()
    back = np.minimum.accumulate(filled[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: len(values) - width + 1], ahead[width - 1 : len(values)])


def sampled_cells(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Cells of the documents that lie one after the other in the buffer and end at `ends`.

    The anchor of a window of `length` bytes is the suffix in it whose q-gram has the least identifier, the
    leftmost of equals. It only depends on the window's bytes, so equal windows have their anchors at the same
    place, and only windows of anchors in one q-gram bucket can be equal. Runs of neighbouring anchors with
    equal surroundings (periodic text) are one cell that counts `n` times.
    Returns anchor, lo, hi of the first anchor, last window of the run, n, core (q-gram bucket), whole (all bytes
    of the cell), all positions in the buffer.
    """
    buckets = Buckets(data, length)
    width = length - buckets.q + 1
    starts = np.concatenate([[0], ends[:-1]])
    roomy = ends - starts >= length
    counts = (ends - starts - length + 1)[roomy]
    if not len(counts):
        none = np.empty(0, np.int64)
        return none, none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    key = (buckets.gram & ~_PLACE) | np.arange(len(buckets.gram), dtype=np.uint64)
    anchors = (_sliding_least(key, width) & _PLACE).astype(np.int64)
    windows = np.arange(counts.sum()) + np.repeat(starts[roomy] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    of = anchors[windows]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(of) != 0) | (np.diff(windows) != 1)]))
    lo, hi, anchor = windows[new], windows[np.concatenate([new[1:], [len(windows)]]) - 1], of[new]
    whole = mix(
        mix(buckets.window[lo] * _K + buckets.window[hi])
        + (anchor - lo).astype(np.uint64) * _K + (hi - lo).astype(np.uint64))
    core = buckets.gram[anchor]
    lead = np.flatnonzero(np.concatenate([[True], (whole[1:] != whole[:-1]) | (lo[1:] != hi[:-1] + 1)]))
    n = np.diff(np.concatenate([lead, [len(lo)]]))
    return anchor[lead], lo[lead], hi[lead], hi[np.concatenate([lead[1:], [len(lo)]]) - 1], n, core[lead], whole[lead]


def _buffers(texts: list[str], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Texts in buffers of bounded size: bytes, ends of the texts in it, number of the first text, offset in it.

    A text longer than a few buffers comes in pieces that overlap by what a window needs; each window is in one.
    """
    at = 0
    while at < len(texts):
        held: list[bytes] = []
        total = 0
        while at + len(held) < len(texts):
            data = texts[at + len(held)].encode("utf-8")
            if held and total + len(data) > _BUFFER:
                break
            held.append(data)
            total += len(data)
        data = np.frombuffer(b"".join(held), np.uint8)
        if total <= 4 * _BUFFER:
            yield data, np.cumsum([len(d) for d in held]), at, 0
        else:
            for base in range(0, total - length + 1, _BUFFER):
                piece = data[base : base + _BUFFER + length - 1]
                yield piece, np.array([len(piece)]), at, base
        at += len(held)


def _anchored(rows: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            numbers = batch.column(0).to_numpy()
            for data, ends, first, base in _buffers(batch.column(1).to_pylist(), length):
                anchor, lo, hi, last, n, core, whole = sampled_cells(data, ends, length)
                doc = np.searchsorted(ends, lo, side="right")
                shift = base - np.concatenate([[0], ends[:-1]])[doc]
                columns = [numbers[first + doc], *((x + shift).astype(np.int32) for x in (anchor, lo, hi, last)), n,
                           np.ones(len(lo), bool), core.view(np.int64), whole.view(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], ["_row", "anchor", "lo", "hi", "last", "n", "own", "core", "whole"])

    return rows.select("_row", "text").mapInArrow(run, CELLS)


def _contexts(rows: DataFrame, cells: DataFrame, length: int) -> DataFrame:
    """Cells with the bytes their windows cover."""
    lists = cells.groupBy("_row").agg(F.collect_list(F.struct("anchor", "lo", "hi", "own")).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out: list[list] = [[] for _ in range(6)]
            for row, text, own in zip(*(batch.column(c).to_pylist() for c in ("_row", "text", "cells")), strict=True):
                data = text.encode("utf-8")
                for cell in own:
                    values = (row, cell["anchor"], cell["lo"], cell["hi"], cell["own"], data[cell["lo"] : cell["hi"] + length])
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["_row", "anchor", "lo", "hi", "own", "data"])

    return rows.select("_row", "text").join(lists, "_row").mapInArrow(
        run, "_row long, anchor int, lo int, hi int, own boolean, data binary")


def _joined(batch: pa.RecordBatch, length: int):
    """The batch's contexts in buffers: buckets of the buffer, and per context its start, anchor, lo and hi there."""
    sizes = np.array([len(d) for d in batch.column("data").to_pylist()])
    at = 0
    while at < len(sizes):
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), _BUFFER)))
        part = batch.slice(at, end - at)
        data = np.frombuffer(b"".join(part.column("data").to_pylist()), np.uint8)
        start = np.concatenate([[0], np.cumsum(sizes[at:end])[:-1]])
        yield part, Buckets(data, length), start, start - part.column("lo").to_numpy().astype(np.int64)
        at = end


def _cut_cells(contexts: DataFrame, length: int) -> DataFrame:
    """Cells of CELL windows at fixed distances from the anchor, with the bucket of the bytes common to all windows
    that a full cell would have (core) and that of all bytes of the windows it has (whole)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for part, buckets, _, shift in _joined(batch, length):
                anchor, lo, hi = (part.column(c).to_numpy().astype(np.int64) for c in ("anchor", "lo", "hi"))
                first, final = (anchor - hi) // CELL, (anchor - lo) // CELL
                times = final - first + 1
                of = np.repeat(np.arange(len(lo)), times)
                number = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + first[of]
                right, left = anchor[of] - number * CELL, anchor[of] - number * CELL - CELL + 1
                cell_lo, cell_hi = np.maximum(lo[of], left), np.minimum(hi[of], right)
                move = shift[of]
                core = mix(span_hashes(buckets.sums, right + move, left + move + length) + number.astype(np.uint64) * _K)
                whole = mix(
                    mix(buckets.window[cell_lo + move] * _K + buckets.window[cell_hi + move])
                    + (anchor[of] - cell_lo).astype(np.uint64) * _K + (cell_hi - cell_lo).astype(np.uint64))
                own = part.column("own").to_numpy(zero_copy_only=False)[of]
                columns = [part.column("_row").to_numpy()[of], *(x.astype(np.int32) for x in (anchor[of], cell_lo, cell_hi, cell_hi)),
                           np.ones(len(of), np.int64), own, core.view(np.int64), whole.view(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], ["_row", "anchor", "lo", "hi", "last", "n", "own", "core", "whole"])

    return contexts.mapInArrow(run, CELLS)


def _cut_windows(contexts: DataFrame, length: int) -> DataFrame:
    """Every window of the cells with 128 bits of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for part, buckets, _, shift in _joined(batch, length):
                lo, hi = (part.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi"))
                times = hi - lo + 1
                of = np.repeat(np.arange(len(lo)), times)
                at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + lo[of]
                here = at + shift[of]
                columns = [part.column("_row").to_numpy()[of], at.astype(np.int32), part.column("own").to_numpy(zero_copy_only=False)[of],
                           buckets.window[here].view(np.int64), span_hashes(buckets.sums, here, here + length).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["_row", "at", "own", "name", "check"])

    return contexts.mapInArrow(run, "_row long, at int, own boolean, name long, check long")


def _refined(cells: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(marks, undecided) of one round of refinement.

    Cells alone in their core bucket have no equal windows anywhere and leave. Cells that share all their bytes
    with another are marked whole. A core bucket with several different wholes, one of them unmarked, stays
    undecided: of each whole one cell goes on, a marked one only as a partner for the others.
    """
    live = cells.groupBy("core").agg(F.sum("n").alias("_n")).where("_n > 1").select("core")
    cells = stored(cells.join(live, "core"), f"{label}-live")
    wholes = stored(
        cells.groupBy("core", "whole").agg(
            F.sum("n").alias("n"), F.max("own").alias("own"), F.min(F.struct("_row", "lo", "anchor", "hi")).alias("first")),
        f"{label}-wholes")
    marks = cells.where("own").join(wholes.where("n > 1").select("core", "whole"), ["core", "whole"]).select("_row", "lo", "last")
    mixed = wholes.groupBy("core").agg(
        F.count(F.lit(1)).alias("kinds"), F.max((F.col("n") == 1) & F.col("own")).alias("wanting")
    ).where("kinds > 1 and wanting").select("core")
    undecided = wholes.join(mixed, "core").select(
        "first._row", "first.anchor", "first.lo", "first.hi", (F.col("own") & (F.col("n") == 1)).alias("own"))
    return marks, undecided


def repeated_windows(rows: DataFrame, length: int) -> DataFrame:
    """(_row, lo, last): runs of starts of windows of `length` bytes that start elsewhere too, of (_row, text)."""
    cells = stored(_anchored(rows, length), "suffix-anchors")
    marks, undecided = _refined(cells, "suffix-anchor")
    contexts = stored(_contexts(rows, undecided, length), "suffix-contexts")
    cell_marks, undecided = _refined(stored(_cut_cells(contexts, length), "suffix-cells"), "suffix-cell")
    # The bytes of an undecided cell come from the context it was cut from.
    parts = undecided.groupBy("_row", "anchor").agg(F.collect_list(F.struct("lo", "hi", "own")).alias("parts"))
    held = contexts.select("_row", "anchor", F.col("lo").alias("from"), F.col("hi").alias("to"), "data").join(
        parts, ["_row", "anchor"]).select("_row", "anchor", "from", "to", "data", F.explode("parts").alias("part")).where(
        "part.lo >= from and part.hi <= to")
    inner = held.select(
        "_row", "anchor", "part.lo", "part.hi", "part.own",
        F.expr(f"substring(data, part.lo - from + 1, part.hi - part.lo + {length})").alias("data"))
    windows = stored(_cut_windows(inner, length), "suffix-windows")
    twice = windows.groupBy("name", "check").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name", "check")
    window_marks = windows.where("own").join(twice, ["name", "check"]).select("_row", F.col("at").alias("lo"), F.col("at").alias("last"))
    return marks.unionByName(cell_marks).unionByName(window_marks)


def _spans(runs: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal byte spans covered by the windows."""
    out: list[tuple[int, int]] = []
    for lo, last in sorted((r["lo"], r["last"]) for r in runs):
        end = last + length
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((lo, end))
    return out


def _whole_letters(data: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the letters whose bytes are all in a span."""
    out, at = [], 0
    for start, end in spans:
        while start < end and data[start] & 0xC0 == 0x80:
            start += 1
        while end > start and end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:start])
        at = max(at, end)
    out.append(data[at:])
    return b"".join(out).decode("utf-8")


def remove_repeats(
    docs: DataFrame, *, length: int = 400, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
) -> DataFrame:
    """Every document without the bytes of `length`-byte strings that start anywhere else too.

    A string may repeat in another document or in its own, overlaps included; all its copies go. What repeats
    is judged on the input. Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the other
    bytes in order), text (the same with letters that are only removed in part put back, so it is valid) and
    the columns named in `keep`. Null and empty texts have no bytes; texts shorter than `length` stay whole.
    Repeated rows are separate documents and lose what they share. An empty table gives no rows; other
    columns are not read. `length` is a multiple of 8.

    The suffixes that take part are sampled by their bytes alone, about one in a hundred, so that equal strings
    sample equal suffixes. Their q-gram buckets are refined with the identifiers of longer stretches at other
    offsets, each made from two shorter ones. Buckets with one member leave at once; what is equal as a whole
    is marked at once; only cells at the edges of repeats go on to smaller cells and then to single windows.
    All buckets are aggregates and joins on hashes, so a bucket of any size is spread or shrinks before the
    shuffle. Marks rest on 128 bits of content. Texts move twice: for the edges and for the removal.
    """
    if length <= 0 or length % (1 << DOUBLINGS):
        raise ValueError("length has to be a multiple of 8")
    rows = with_row(
        docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), *keep), "doc_id", "text", *keep)
    marks = repeated_windows(rows.select("_row", "text"), length).groupBy("_row").agg(
        F.collect_list(F.struct("lo", "last")).alias("_runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out: list[list] = [[] for _ in range(5)]
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("_runs").to_pylist(), strict=True):
                data = text.encode("utf-8")
                spans = _spans(runs or [], length)
                kept = b"".join(data[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(data)], strict=True))
                for column, value in zip(out, (len(data), len(data) - len(kept), len(spans), kept, _whole_letters(data, spans)), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True)), *(batch.column(c) for c in keep)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "text", *keep])

    schema = [f"doc_id {rows.schema['doc_id'].dataType.simpleString()}", "n_bytes long, n_removed long, n_spans long, kept binary, text string"]
    schema += [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.join(marks, "_row", "left").drop("_row").mapInArrow(run, ", ".join(schema))
