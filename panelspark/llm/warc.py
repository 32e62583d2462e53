"""WARC archives with revisits, read back into an index that is merged from sorted runs.

Writing: equal payloads are found by SHA-1; of a group the largest page_id is the response and the others are revisits
that refer to it and carry no payload. Records are sorted by URL key and time within each file and written as text whose
line separator is the end of a record, so the files are plain WARC 1.1 (gzip over the whole file).

Reading: every file is parsed once and gives one sorted run of captures. The runs are dealt by ranges of (URL key, time,
page_id); in each range the runs that reach it are merged by a loser tree, which yields globally ordered capture
histories: range by range, and in order within each. A range holds rows of one URL only in part if the URL is hot.

Cases: a null payload is empty; a null URL has no target header and sorts as the empty key; a null page_id is a response
only if its whole group has none; rows that repeat the response's page_id and payload are responses too; line breaks in a
URL are percent-encoded in the header; an empty table writes no record and gives an empty index.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelspark.llm.common import partitions, scratch, table

CRLF, END = "\r\n", "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ORDER = ["url_key", "time", "page_id"]
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed values: RFC 4648


def base32(hexes: Column) -> Column:
    """Base32 of 40 hex digits: 32 groups of five bits."""
    bits = F.lpad(F.conv(F.substring(hexes, 1, 10), 16, 2), 40, "0")
    for i in range(1, 4):
        bits = F.concat(bits, F.lpad(F.conv(F.substring(hexes, 1 + 10 * i, 10), 16, 2), 40, "0"))
    letters = [F.substring(F.lit(BASE32), F.conv(F.substring(bits, 1 + 5 * i, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(32)]
    return F.concat(*letters)


def url_key(url: Column) -> Column:
    """Host labels in reverse order, then path and query, lower case: captures of a site lie together."""
    rest = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://|#.*$", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/?]*)", 1), r"^www\d*\.|:\d+$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(rest, r"^[^/?]*", ""))


def typed(pages: DataFrame) -> DataFrame:
    """``pages`` with digest (hex), record_type and refers_to."""
    digest = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    first = pages.select("page_id", digest.alias("_digest")).groupBy("_digest").agg(F.max("page_id").alias("_first"))
    rows = pages.withColumn("digest", digest).join(first, F.col("digest") == F.col("_digest"))
    response = F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.withColumns({
        "record_type": F.when(response, "response").otherwise("revisit"), "refers_to": F.when(~response, F.col("_first")),
    }).drop("_digest", "_first")


def records(rows: DataFrame, start: str) -> DataFrame:
    """(url_key, time, page_id, record): WARC headers and block, without the end of the record."""
    seconds = F.unix_timestamp(F.lit(start)) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9))
    time = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    payload, is_response = F.coalesce("html", F.lit("")), F.col("record_type") == "response"
    block = F.when(is_response, F.concat(F.lit(HTTP), payload)).otherwise(F.lit(HTTP))
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))

    def header(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))
    head = F.concat_ws("", *[
        F.lit("WARC/1.1\r\n"), header("WARC-Type", F.col("record_type")),
        header("WARC-Record-ID", F.concat(F.lit("<urn:capture:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":"), F.col("digest"), F.lit(">"))),
        header("WARC-Date", time), header("WARC-Target-URI", target),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest")))),
        F.when(~is_response, F.concat(
            header("WARC-Profile", F.lit(PROFILE)),
            header("WARC-Refers-To", F.concat(F.lit("<urn:capture:"), F.col("refers_to").cast("string"), F.lit(":"), F.col("digest"), F.lit(">"))),
            header("X-Full-Payload-Length", F.octet_length(payload)))),
        header("X-Page-Id", F.col("page_id")), header("Content-Type", F.lit("application/http; msgtype=response")),
        header("Content-Length", F.octet_length(block)), F.lit(CRLF), block])
    return rows.select(url_key(F.col("url")).alias("url_key"), time.alias("time"), "page_id", head.alias("record"))


def write_archives(pages: DataFrame, folder: str, start: str = "2024-01-01 00:00:00", per_file: int = 2000) -> None:
    """Write a record for every row of ``pages`` (page_id, url, html); files of at most ``per_file`` records."""
    out = records(typed(pages.select("page_id", "url", "html")), start).sortWithinPartitions(*ORDER).select("record")
    out.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(folder)


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of every record of an unpacked archive."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "surrogatepass").split(CRLF)
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no WARC record at {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        block = data[stop + 4:stop + 4 + size]
        if len(block) != size or data[stop + 4 + size:stop + 8 + size] != END.encode():
            raise ValueError(f"record at {at} is cut")
        yield at, headers, block
        at = stop + 8 + size


def capture(headers: dict[str, str], block: bytes) -> dict:
    payload = block[block.index(b"\r\n\r\n") + 4:]
    digest, refers = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers.get("WARC-Refers-To")
    if refers is None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of {headers['WARC-Record-ID']} does not fit its digest")
    page = headers.get("X-Page-Id")
    url = headers.get("WARC-Target-URI")
    return {
        "page_id": None if page is None else int(page), "time": headers["WARC-Date"],
        "url": url if url is None or "%0" not in url else url.replace("%0D", unquote("%0D")).replace("%0A", unquote("%0A")),
        "record_type": headers["WARC-Type"], "payload_digest": digest,
        "payload_bytes": int(headers["X-Full-Payload-Length"]) if refers else len(payload),
        "refers_to": int(refers.split(":")[2]) if refers else None,
    }


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: the captures of all files in ``folder``, each file a sorted run."""
    def run(batches):
        kind = pa.schema([("page_id", pa.int64()), ("time", pa.string()), ("url", pa.string()), ("record_type", pa.string()),
                          ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()),
                          ("file", pa.string()), ("offset", pa.int64())])
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                name = path.as_py().rsplit("/", 1)[-1]
                rows = [capture(h, block) | {"file": name, "offset": at} for at, h, block in parse(gzip.decompress(content.as_py()))]
                yield pa.RecordBatch.from_pylist(rows, kind)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", "content")
    columns = ("page_id long, time string, url string, record_type string, payload_digest string, payload_bytes long, "
               "refers_to long, file string, offset long")
    got = files.mapInArrow(run, columns)
    return got.select(url_key(F.col("url")).alias("url_key"), *got.columns)


class LoserTree:
    """Merge k sorted sources: each inner node holds the loser of its match, the root the winner."""

    def __init__(self, sources: list[Iterator[tuple]]):
        self.sources, self.k = sources, len(sources)
        self.heads = [next(s, None) for s in sources]
        self.losers = [-1] * max(self.k, 1)
        for leaf in range(self.k):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None if x is None or y is None else (x, a) < (y, b)

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self.losers[node] < 0:  # first pass: wait for the opponent
                self.losers[node] = winner
                return
            if self._beats(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.losers[0]] is not None:
            winner = self.losers[0]
            yield self.heads[winner]
            self.heads[winner] = next(self.sources[winner], None)
            self._play(winner)


def merged(captures: DataFrame, ranges: int | None = None) -> DataFrame:
    """The captures in global order of (URL key, time, page_id), merged from the runs in each range."""
    spark, columns = captures.sparkSession, captures.columns
    lead = [columns.index(c) for c in ORDER]

    def key(row: tuple) -> tuple:
        return tuple((row[i] is not None, row[i] if row[i] is not None else 0) for i in lead)

    def run(batches):
        runs: dict[str, list[tuple]] = {}
        kind = None
        for b in batches:
            kind, name = b.schema, b.schema.get_field_index("file")
            for row in zip(*(c.to_pylist() for c in b.columns)):
                runs.setdefault(row[name], []).append(row)
        tree = LoserTree([((key(r), n, i, r) for i, r in enumerate(runs[f])) for n, f in enumerate(sorted(runs))])
        part: list[tuple] = []
        for *_, row in tree:
            part.append(row)
            if len(part) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), kind)], schema=kind)
                part = []
        if part:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), kind)], schema=kind)
    dealt = captures.repartitionByRange(ranges or partitions(spark), *ORDER)
    # a shuffle does not keep a run's order; it is sorted again by file and offset, which is the order it was written in
    return dealt.sortWithinPartitions("file", "offset").mapInArrow(run, captures.schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder)
    out = merged(read_archives(spark, folder))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "time", "file", "offset")
