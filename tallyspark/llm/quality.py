"""Quality rules: counts of a document's own text, and lines that too many documents of one host share.

Cross-document line frequency: every line with a word is normalised and hashed; per host the distinct
documents holding each hash are counted (a line counts once per document, map-side combined, so a very common
line is a few partial counts per task). Hashes held by `min_docs` or more documents of a host are that host's
boilerplate and are removed from its documents; a document that loses more than `max_removed` of its word
characters that way is depleted and rejected.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tallyspark.llm.common import stored

# Fixed values of the base rules: blanks between words, symbol characters, window of repeated words.
BLANK = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 3
# Rows of boilerplate keys that may be sent whole to every task; beyond it they are joined by salted keys.
BROADCAST_ROWS = 1 << 20
SALTS = 16


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by a window of `window` consecutive words that occurs twice or more, the first time included."""
    grams = list(zip(*(words[i:] for i in range(window))))
    seen = Counter(grams)
    covered = bytearray(len(words))
    for i, gram in enumerate(grams):
        if seen[gram] > 1:
            covered[i : i + window] = b"\x01" * window
    return covered.count(1)


@F.pandas_udf(LongType())
def _repeat_words(texts: pd.Series) -> pd.Series:
    return pd.Series([repeated_words(t.encode("utf-8").split()) if t else 0 for t in texts], dtype="int64")


def base_counts(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text column (null: no text).

    Words are runs of characters other than space and tab to CR; word_chars counts their code points;
    n_symbols counts the characters #*$%&|<> anywhere; n_dup_lines counts LF-split lines with a word that equal
    an earlier line of the text.
    """
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda line: line.rlike(f"[^{BLANK[1:-1]}]"))
    return {
        "n_words": F.size(F.filter(F.split(t, f"{BLANK}+", -1), lambda w: w != "")).cast("long"),
        "word_chars": F.char_length(F.regexp_replace(t, BLANK, "")).cast("long"),
        "n_symbols": (F.char_length(t) - F.char_length(F.regexp_replace(t, SYMBOL, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _repeat_words(t),
    }


def _line_keys(text: Column) -> Column:
    """Per line with a word: its normalised hash (two independent hashes, 96 bits) and the code points of its words."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line: line.rlike(f"[^{BLANK[1:-1]}]"))

    def key(line: Column) -> Column:
        norm = F.trim(F.regexp_replace(F.lower(line), f"{BLANK}+", " "))
        return F.struct(F.xxhash64(norm).alias("h1"), F.hash(norm).alias("h2"), F.char_length(F.regexp_replace(line, BLANK, "")).alias("wc"))

    return F.transform(lines, key)


def quality(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 10,
    max_removed: float = 0.5, min_words: int = 50, max_repeat: float = 0.5,
) -> DataFrame:
    """Per row: the identifier, the base counts, base_failed, removed_lines, removed_chars, depleted and kept.

    base_failed: fewer than `min_words` words, or more than `max_repeat` of the words in repeated windows.
    removed_lines / removed_chars: lines (and their word code points) whose normalised form (lower case, blank
    runs as one space, trimmed) `min_docs` or more documents of the same host hold. depleted: removed_chars
    over `max_removed` of word_chars. kept: neither base_failed nor depleted.

    Nulls: a null text has no words (base_failed); a null host is a host of its own. Repeated rows are
    documents of their own and each counts a line once; identical repeated rows (identifier, host and text)
    get one result each. An empty table gives no rows. Only the three named columns are read.
    """
    text, host = F.col(text_col), F.col(host_col)
    row_key = F.struct(F.col(id_col).alias("i"), F.xxhash64(host, text).alias("h"), F.hash(host, text).alias("g"))
    counted = base_counts(text)
    base = docs.select(F.col(id_col).alias("doc_id"), row_key.alias("_rk"), *(c.alias(n) for n, c in counted.items()))
    base = base.withColumn("base_failed", (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeat * F.col("n_words")))

    lines = docs.select(row_key.alias("_rk"), host.alias("host"), _line_keys(text).alias("lines"))
    held = lines.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.struct(x["h1"], x["h2"])))).alias("k"))
    common = held.groupBy("host", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2")).count().where(F.col("count") >= min_docs)
    common = stored(common.select(F.col("host").alias("c_host"), F.col("h1").alias("c1"), F.col("h2").alias("c2")), "quality-common")
    found = lines.select("_rk", "host", F.posexplode("lines").alias("pos", "line")).select(
        "_rk", "host", "pos", F.col("line.h1").alias("h1"), F.col("line.h2").alias("h2"), F.col("line.wc").alias("wc"))
    same = F.col("host").eqNullSafe(F.col("c_host")) & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2"))
    if common.count() <= BROADCAST_ROWS:
        hit = found.join(F.broadcast(common), same, "left_semi")
    else:
        spread = common.withColumn("c_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = found.withColumn("_salt", F.pmod(F.xxhash64("_rk", "pos"), F.lit(SALTS)))
        hit = salted.join(spread, same & (F.col("_salt") == F.col("c_salt")), "left_semi").drop("_salt")
    # Identical rows share a key: count each line of a key once.
    removed = hit.repartition("_rk").groupBy("_rk", "pos").agg(F.max("wc").alias("wc")).groupBy("_rk").agg(
        F.count(F.lit(1)).alias("removed_lines"), F.sum("wc").alias("removed_chars"))
    out = base.join(removed, "_rk", "left").drop("_rk").fillna(0, ["removed_lines", "removed_chars"])
    out = out.withColumn("depleted", F.col("removed_chars") > max_removed * F.col("word_chars"))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
