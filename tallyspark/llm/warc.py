"""WARC archives and their index, merged from sorted runs."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import stored, work_path

RECORD = "urn:x-page:"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"
# Printable ASCII but the blank; anything else could end a header line.
_SAFE = "".join(map(chr, range(0x21, 0x7F)))


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode("ascii")


def _date(seconds: int) -> str:
    return datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels from the last to the first, path, sorted parameters; all in lower case.

    Scheme, default port, a leading www and the fragment do not count. A null URL has an empty key, one that cannot be
    parsed is its own key.
    """
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    labels = ",".join(reversed(re.sub(r"^www\d*\.", "", host).split(".")))
    shown = f":{port}" if port and port not in (80, 443) else ""
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{labels}{shown}){parts.path or '/'}{'?' + query if query else ''}"


def _record(page_id: int | None, url: str | None, html: str, seconds: int, refers_to: int | None, revisit: bool) -> str:
    payload = html.encode("utf-8")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}{_END}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{RECORD}{'none' if page_id is None else page_id}>",
            f"WARC-Date: {_date(seconds)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_SAFE)}")
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{RECORD}{refers_to}>"]
    size = len(http) + (0 if revisit else len(payload))
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {size}"]
    return "\r\n".join(head) + _END + http + ("" if revisit else html)


def write_archives(
    pages: DataFrame, path: str, *, when: Column | None = None, min_revisit_bytes: int = 0, records_per_file: int = 4096,
    compression: str = "gzip",
) -> None:
    """Write a WARC record per row of (page_id, url, html) as archives in the folder `path`.

    Of the rows whose payloads (the html in UTF-8; null: empty) are equal and have at least `min_revisit_bytes`
    bytes, the one with the largest page_id is a response and the others are revisits of it; smaller payloads
    are all responses. Null page_ids are smaller than any other; if a group has no other, all its rows are
    responses, as are repeated rows with the largest page_id. `when` is the capture time in seconds since 1970,
    by default page_id seconds after the start of 2020.

    Spark's text writer makes the files: a record is text, and the separator it writes after each is the end of a
    WARC record. So archives go wherever Spark writes, and a lost task writes its file again. Equal payloads
    meet by digest only in an aggregate of identifiers. With `compression` gzip an archive is one gzip stream and
    places in it count the bytes before compression; with none a record can be read from its place in the file.
    """
    seconds = F.coalesce(when if when is not None else F.lit(1577836800) + F.pmod("page_id", F.lit(1_000_000_000)), F.lit(1577836800))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), seconds.cast("long").alias("seconds"),
    ).withColumn("content", F.unhex(F.sha2("html", 256)))
    keepers = rows.groupBy("content").agg(F.max("page_id").alias("keeper"))
    revisit = (F.octet_length("html") >= min_revisit_bytes) & F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    marked = rows.join(keepers, "content").select("page_id", "url", "html", "seconds", "keeper", revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = [_record(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.string())], ["value"])

    marked.mapInArrow(run, "value string").write.option("lineSep", _END).option("maxRecordsPerFile", records_per_file).option(
        "compression", compression).text(path)


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8").split("\r\n")[1:])}


def parse_archive(content: bytes) -> Iterator[tuple[int, int, dict[str, str], int, str, bytes | None]]:
    """Records of an archive: offset, length, header fields, payload size, payload digest, payload (null for revisits).

    A response's size and digest are taken from its payload, a revisit's from what it says of the full one. A damaged
    archive is an error.
    """
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if not content.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        fields = _fields(content[at:end])
        block = content[end + 4 : end + 4 + int(fields["content-length"])]
        http, _, body = block.partition(b"\r\n\r\n")
        after = end + 4 + len(block)
        if len(block) != int(fields["content-length"]) or content[after : after + 4] != b"\r\n\r\n":
            raise ValueError(f"broken WARC record at byte {at}")
        said = fields["warc-payload-digest"].removeprefix("sha1:")
        if fields["warc-type"] == "revisit":
            yield at, after + 4 - at, fields, int(_fields(http)["content-length"]), said, None
        else:
            found = payload_digest(body)
            if found != said:
                raise ValueError(f"payload of the WARC record at byte {at} does not match its digest")
            yield at, after + 4 - at, fields, len(body), found, body
        at = after + 4


ENTRY = (
    "archive string, offset long, length long, url_key string, captured string, page_id long, url string, payload_bytes long, "
    "payload_digest string, record_type string, refers_to long")


def read_archives(spark: SparkSession, path: str, *, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives in `path`, those of an archive sorted by URL key and capture time.

    With `with_payload` also the payload (null for revisits). A record's bytes are `length` from `offset` of its archive,
    before compression.
    """
    names = [part.split()[0] for part in ENTRY.split(", ")]
    kinds = [pa.int64() if part.endswith(" long") else pa.string() for part in ENTRY.split(", ")]

    def number(uri: str | None) -> int | None:
        tail = (uri or "").strip("<>").removeprefix(RECORD)
        return int(tail) if tail not in ("", "none") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                data = content.as_py()
                data = gzip.decompress(data) if data.startswith(b"\x1f\x8b") else data
                for offset, length, fields, size, digest, payload in parse_archive(data):
                    url = fields.get("warc-target-uri")
                    row = (archive, offset, length, url_key(url), fields["warc-date"], number(fields["warc-record-id"]), url, size, digest,
                           fields["warc-type"], number(fields.get("warc-refers-to")))
                    rows.append((*row, payload) if with_payload else row)
                rows.sort(key=lambda r: (r[3], r[4], r[1]))
                columns = list(zip(*rows, strict=True)) or [[] for _ in range(len(names) + with_payload)]
                used = list(zip([*names, "payload"], [*kinds, pa.binary()], columns))  # noqa: B905
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for _, k, c in used], [n for n, _, _ in used])

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(run, ENTRY + (", payload binary" if with_payload else ""))


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so the next least key takes one path to the top."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.losers = [-1] * max(1, len(runs))
        self.winner = self._build(1) if runs else -1

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a's next key comes before run b's; an empty run comes last, equal keys by the run's number."""
        ends_a, ends_b = self.at[a] >= len(self.runs[a]), self.at[b] >= len(self.runs[b])
        if ends_a or ends_b:
            return ends_b and (not ends_a or a < b)
        return (self.runs[a][self.at[a]], a) < (self.runs[b][self.at[b]], b)

    def _build(self, node: int) -> int:
        k = len(self.runs)
        if node >= k:
            return node - k
        left, right = self._build(2 * node), self._build(2 * node + 1)
        first, second = (left, right) if self._beats(left, right) else (right, left)
        self.losers[node] = second
        return first

    def __iter__(self) -> Iterator[tuple]:
        k = len(self.runs)
        while self.winner >= 0 and self.at[self.winner] < len(self.runs[self.winner]):
            run = self.winner
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            node = (run + k) // 2
            while node:
                if self._beats(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


def merge_index(entries: DataFrame, *, range_rows: int = 16_384) -> DataFrame:
    """The entries of all archives in one order: by URL key, capture time and page, over all partitions.

    Each archive's entries are a sorted run. Ranges of (URL key, capture time, page) of about `range_rows` entries
    are dealt out, so even a URL with most of the captures is spread; a task merges the parts of all runs in its
    range with a loser tree. Entries hold no payload.
    """
    held = stored(entries, "warc-runs")
    ranges = max(1, math.ceil(held.count() / range_rows))
    schema = held.schema
    columns = schema.names
    key = [columns.index(c) for c in ("url_key", "captured", "page_id", "archive", "offset")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        whole = pa.Table.from_batches(tables)
        values = [c.to_pylist() for c in whole.columns]
        runs: dict[str, list[tuple]] = {}
        for i, row in enumerate(zip(*(values[k] for k in key), strict=True)):
            # A null page comes first.
            runs.setdefault(row[3], []).append((row[0], row[1], row[2] is not None, row[2] or 0, row[3], row[4], i))
        order = [entry[-1] for entry in LoserTree(list(runs.values()))]
        yield from whole.take(pa.array(order, pa.int64())).combine_chunks().to_batches()

    dealt = held.repartitionByRange(ranges, "url_key", "captured", "page_id").sortWithinPartitions(
        "archive", "url_key", "captured", F.asc_nulls_first("page_id"), "offset")
    return dealt.mapInArrow(run, schema)


def archive_and_index(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the pages as archives (to `path`, or a fresh one in the shared folder), read them back and merge their index."""
    path = path or work_path(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    return merge_index(read_archives(pages.sparkSession, path))
