"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import small
from tallyspark.llm.hashing import mix

UNDETERMINED = "und"
_STEP = 1 << 19
_K = np.uint64(0x9E3779B97F4A7C15)


def _lowered(codes: np.ndarray) -> np.ndarray:
    """Lower case and a blank for everything that is no letter, code point by code point."""
    table = _LETTERS
    out = np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], codes)
    beyond = np.flatnonzero(codes >= len(table))
    for code in np.unique(out[beyond]):
        letter = chr(code)
        out[beyond[out[beyond] == code]] = ord(letter.lower()[0]) if letter.isalpha() else 0x20
    return out


_LETTERS = np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 0x20 for c in range(0x3000)], np.uint32)


class NGrams:
    """Counts of the character n-grams of a text in hashed buckets.

    Letters are folded to lower case; runs of anything else are one blank, as are both ends. Long texts are
    counted in steps, so memory does not grow with the text.
    """

    def __init__(self, bits: int, longest: int):
        self.bits, self.longest = bits, longest

    def counts(self, text: str) -> np.ndarray:
        total = np.zeros(1 << self.bits, np.int64)
        tail = np.array([0x20], np.uint32)
        for at in range(0, len(text) + 1, _STEP):
            final = at + _STEP > len(text)
            codes = np.frombuffer((text[at : at + _STEP] + " " * final).encode("utf-32-le", "surrogatepass"), np.uint32)
            fresh = _lowered(codes)
            joined = np.concatenate([tail, fresh])
            keep = np.ones(len(joined), bool)
            keep[1:] = (joined[1:] != 0x20) | (joined[:-1] != 0x20)
            keep[: len(tail)] = True
            joined = joined[keep].astype(np.uint64)
            old = len(tail)
            value = np.zeros(len(joined), np.uint64)
            for n in range(1, self.longest + 1):
                size = len(joined) - n + 1
                if size <= 0:
                    break
                value = value[:size] * _K + joined[n - 1 :]
                # Only n-grams that end in the new part; the others were counted with it before.
                first = max(0, old - n + 1)
                bucket = (mix(value[first:] + np.uint64(n)) >> np.uint64(64 - self.bits)).astype(np.int64)
                total += np.bincount(bucket, minlength=len(total))
            tail = joined[-(self.longest - 1) :].astype(np.uint32) if self.longest > 1 else joined[-1:].astype(np.uint32)
        return total


@dataclass
class Model:
    """Weights of the languages, document weights of the n-gram buckets, and the temperature of the scores."""

    languages: list[str]
    grams: NGrams
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and their TF-IDF values (logarithmic frequency, unit length)."""
        return _weighed(self.grams.counts(text), self.idf)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        at, value = self.features(text)
        scores = (value @ self.weights[at] + self.bias) / self.temperature
        share = np.exp(scores - scores.max())
        best = int(scores.argmax())
        return self.languages[best], float(share[best] / share.sum())


def _weighed(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    value = (1 + np.log(counts[at])) * idf[at]
    return at, value / max(1e-12, math.sqrt(float(value @ value)))


def _document_counts(texts: DataFrame, grams: NGrams) -> tuple[np.ndarray, int]:
    """In how many of the texts each bucket occurs, over all of them, and their number.

    Each task sends its counts as rows; the sums have one row per bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(1 << grams.bits, np.int64), 0
        for batch in small(batches):
            for text in batch.column(0).to_pylist():
                found += grams.counts(text or "") > 0
                n += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(found[at], n))], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << grams.bits, np.int64)
    bucket, n = rows.column("bucket").to_numpy(), rows.column("n").to_numpy()
    out[bucket[bucket >= 0]] = n[bucket >= 0]
    return out, int(n[bucket < 0].sum())


def follow_the_regularised_leader(
    examples: list[tuple[np.ndarray, np.ndarray, int]], buckets: int, classes: int, *, epochs: int, alpha: float, beta: float,
    l1: float, l2: float, seed: int = 7,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (buckets x classes) and bias of a multinomial logistic regression.

    Per coordinate the leader on all gradients so far is followed, held back by an elastic net: l1 keeps weak
    weights at zero, l2 shrinks the others, and the rate falls with the coordinate's own squared gradients.
    """
    z, n = np.zeros((buckets + 1, classes)), np.zeros((buckets + 1, classes))
    target = np.eye(classes)
    rng = np.random.default_rng(seed)

    def weights(rows) -> np.ndarray:
        own = z[rows]
        return np.where(np.abs(own) <= l1, 0.0, -(own - np.sign(own) * l1) / ((beta + np.sqrt(n[rows])) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            at, value, label = examples[i]
            # The last row is the bias, with value 1.
            rows, x = np.append(at, buckets), np.append(value, 1.0)
            w = weights(rows)
            scores = x @ w
            share = np.exp(scores - scores.max())
            gradient = x[:, None] * (share / share.sum() - target[label])[None, :]
            sigma = (np.sqrt(n[rows] + gradient**2) - np.sqrt(n[rows])) / alpha
            z[rows] += gradient - sigma * w
            n[rows] += gradient**2
    whole = weights(slice(None))
    return whole[:-1], whole[-1]


def best_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        s = scores / math.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]).mean())

    low, high, ratio = math.log(0.05), math.log(20), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return math.exp((low + high) / 2)


def fit(
    labelled: DataFrame, *, bits: int = 15, longest: int = 3, per_language: int = 1200, languages_most: int = 400,
    epochs: int = 2, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1, calibration: float = 0.2,
) -> Model:
    """A model from rows (text, lang) with a language.

    Document counts, languages and their sizes come from all rows. The weights are fitted on the driver on at
    most `per_language` whole texts of each language, chosen by a hash of the row's number, and a share `calibration` of
    those only sets the temperature. More than `languages_most` languages are refused. No labelled row gives
    an error.
    """
    grams = NGrams(bits, longest)
    usable = labelled.where("lang is not null and text is not null").select("text", "lang")
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(languages_most + 1).collect()}
    if not sizes:
        raise ValueError("no labelled text to learn from")
    if len(sizes) > languages_most:
        raise ValueError(f"more than {languages_most} languages")
    languages = sorted(sizes)
    found, total = _document_counts(usable, grams)
    idf = np.log((1 + total) / (1 + found)) + 1

    # A threshold on a hash of the text keeps about so many texts of each language; the excess over the bound is
    # cut after. The hash depends on the row alone, so the sample is the same however the table is split.
    share = F.element_at(
        F.create_map(*[c for name in languages for c in (F.lit(name), F.lit(min(1.0, 1.2 * per_language / sizes[name])))]), F.col("lang"))
    point = F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 20)) / float(1 << 20)
    chosen = usable.select("text", "lang", point.alias("point"), F.hash("text", "lang").alias("tie")).where(F.col("point") < share)
    kind = "smallint" if bits <= 15 else "int"

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = pa.int16() if bits <= 15 else pa.int32()
        for batch in small(batches):
            pairs = [_weighed(grams.counts(t), idf) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("lang"), batch.column("point"), batch.column("tie"),
                pa.array([p[0] for p in pairs], pa.list_(width)), pa.array([p[1].astype(np.float32) for p in pairs], pa.list_(pa.float32()))],
                ["lang", "point", "tie", "at", "value"])

    # Texts arrive in a fixed order, one partition at a time; each is kept as two small arrays (2 or 4 bytes and
    # 4 bytes a feature), never as Python numbers, and those over a language's bound are dropped on arrival.
    featured = chosen.mapInArrow(featurise, f"lang string, point double, tie int, at array<{kind}>, value array<float>")
    taken: dict[str, int] = {}
    train, held = [], []
    for row in featured.orderBy("point", "lang", "tie").toLocalIterator():
        nth = taken[row["lang"]] = taken.get(row["lang"], 0) + 1
        if nth <= per_language:
            example = (np.array(row["at"], np.int32), np.array(row["value"], np.float32), languages.index(row["lang"]))
            (held if nth % round(1 / calibration) == 0 else train).append(example)
    weights, bias = follow_the_regularised_leader(
        train, 1 << bits, len(languages), epochs=epochs, alpha=alpha, beta=beta, l1=l1, l2=l2)
    scores = np.array([v @ weights[at] + bias for at, v, _ in held]).reshape(-1, len(languages))
    temperature = best_temperature(scores, np.array([label for _, _, label in held], int))
    return Model(languages, grams, idf, weights.astype(np.float32), bias, temperature)


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """lang_pred and score (calibrated probability of it) of every row's whole text, and the columns named in `keep`.

    A null text or one without letters is `und` with score 0. Rows never move; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(text_col).cast("string").alias("_text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            said = [shared.value.predict(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64()), *batch.columns[1:]],
                ["lang_pred", "score", *keep])

    kept = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.mapInArrow(run, ", ".join(["lang_pred string, score double", *kept]))


def fold(id_col: str = "doc_id") -> Column:
    """Whether a document is held out: crc32 of its identifier as text, modulo 3, is 1. A null one is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of (doc_id, text, lang).

    Learns from the rows with a language that are not held out; lang, source and doc_id are no inputs of a
    prediction. Repeated rows are predicted alike; an empty table, or one without a row to learn from, gives `und`
    with score 0 for every row. Options are those of `fit`.
    """
    learn = docs.where(~fold()).select("text", "lang")
    rows = docs.select("doc_id", fold().alias("held_out"), "text")
    if learn.where("lang is not null and text is not null").isEmpty():
        return rows.select("doc_id", "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    model = fit(learn, **options)
    return predict(rows, model, keep=("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score")
