"""WARC archives with revisit records, and an external merge of their capture indexes.

Writing.  Pages become WARC/1.1 records, composed by Spark's own functions and written as gzip files in the shared
folder.  Of equal payloads the page with the largest id is a ``response``; the others are ``revisit`` records, which
hold the HTTP head only.

Reading.  Every archive is read back on its own and gives a capture run: its captures, sorted by URL key, timestamp
and page.  Runs are dealt out by ranges of that key, so a URL with a third of all captures is cut into several
ranges; a task merges its runs with a loser tree.  The ranges in order are the globally ordered capture histories.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise, shared_path

CRLF = "\r\n"
END = CRLF * 2
#: Pages carry no time: a page counts as captured as many seconds after this as its id says.
BASE_TIME = 1_704_067_200
#: Larger ids share the last second of a four-digit year, and smaller ones the first; the id itself keeps them in order.
LAST = 253_402_300_799 - BASE_TIME
#: Largest payload in bytes, and how many such records an archive may hold: none grows beyond 128 MB or one record.
SIZES = [(1 << 16, 2048), (1 << 20, 128), (1 << 24, 8), (None, 1)]
FIELDS = ("urlkey", "timestamp", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "archive", "offset", "length")
SCHEMA = (
    "urlkey string, timestamp string, page_id long, payload_bytes long, payload_digest string, record_type string,"
    " refers_to long, url string, archive string, offset long, length long"
)
ARROW = pa.schema([(n, pa.int64() if n in ("page_id", "payload_bytes", "refers_to", "offset", "length") else pa.string()) for n in FIELDS])


def base32_sha1(text: Column) -> Column:
    """SHA-1 in upper-case base 32: ten hexadecimal digits are eight of base 32."""
    digits = F.concat(*[F.lpad(F.conv(F.substring(F.sha1(text), 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: str) -> str:
    """Host labels in reverse, then path and query, in lower case: captures of one site stand together."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)", url.strip(), re.I)
    if not m:
        return url.strip().lower()
    host = re.sub(r"^www\d*\.", "", m[1].lower())
    return ",".join(reversed(host.split("."))) + (m[2] or "") + ")" + (m[3].lower() or "/")


def kept_copies(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """same, kept: of payloads that stand on several pages, the digest and the largest id."""
    rows = pages.select(F.col(page).cast("long").alias("page_id"), F.sha2(F.coalesce(F.col(html), F.lit("")), 256).alias("same"))
    return materialise(rows.groupBy("same").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n"), "op1-copies")


def records(pages: DataFrame, copies: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One column ``record``: the text of each page's WARC record without the two line ends that close it."""
    rows = pages.select(
        F.col(page).cast("long").alias("page_id"),
        # A line end in a URL would end the header.
        F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "[\\r\\n]+", "%0A").alias("url"),
        F.coalesce(F.col(html), F.lit("")).alias("payload"),
    ).withColumn("same", F.sha2("payload", 256))
    told = rows.join(copies, "same", "left").withColumn("revisit", F.col("kept").isNotNull() & ~F.col("kept").eqNullSafe(F.col("page_id")))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END)
    )
    block = F.concat(head, F.when(F.col("revisit"), "").otherwise(F.col("payload")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    second = F.timestamp_seconds(F.lit(BASE_TIME) + F.greatest(F.least(F.coalesce("page_id", F.lit(0)), F.lit(LAST)), F.lit(0)))
    when = F.date_format(F.to_utc_timestamp(second, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lines = [
        ("WARC-Type: ", F.when(F.col("revisit"), "revisit").otherwise("response")),
        ("WARC-Record-ID: ", name("page_id")),
        ("WARC-Date: ", when),
        ("WARC-Target-URI: ", F.col("url")),
        ("WARC-Payload-Digest: sha1:", base32_sha1(F.col("payload"))),
        ("Content-Type: ", F.lit("application/http; msgtype=response")),
        ("Content-Length: ", F.octet_length("block").cast("string")),
    ]
    refers = F.concat(
        F.lit("WARC-Refers-To: "), name("kept"), F.lit(CRLF + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF)
    )
    text = F.concat(
        F.lit("WARC/1.1" + CRLF), *[x for n, v in lines for x in (F.lit(n), v, F.lit(CRLF))], F.when(F.col("revisit"), refers).otherwise(""), F.lit(CRLF), F.col("block")
    )
    return told.withColumn("block", block).select(text.alias("record"))


def write_archives(pages: DataFrame, records_per_file: int = 2000, page: str = "page_id", url: str = "url", html: str = "html") -> str:
    """Write the pages' records to gzip WARC files in the shared folder, by classes of size, so that an archive holds at
    most ``records_per_file`` records and 128 MB, or one record; returns the folder.  Two line ends close each record,
    so they serve as the writer's separator."""
    path = shared_path(pages.sparkSession, "op1-warc")
    size = F.coalesce(F.octet_length(html), F.lit(0))
    bounds = [(low, high, n) for (low, _), (high, n) in zip([(-1, 0), *SIZES], SIZES, strict=False)]
    of_size = lambda low, high: (size > low) & (size <= high if high else F.lit(True))
    held = pages.agg(*[F.coalesce(F.sum(of_size(low, high).cast("int")), F.lit(0)) for low, high, _ in bounds]).first()
    copies = kept_copies(pages, page, html)
    for (low, high, n), some in zip(bounds, held, strict=True):
        if some or low < 0:
            out = records(pages.where(of_size(low, high)), copies, page, url, html).write.option("lineSep", END).option("compression", "gzip")
            out.mode("append").option("maxRecordsPerFile", min(n, records_per_file)).text(path)
    return path


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], int, int, int]]:
    """Headers, offset, start of the block and its end, of each record of an unpacked archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        block, size = end + 4, int(headers["Content-Length"])
        yield headers, at, block, block + size
        at = block + size + 4


def _number(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[9], row[8]


def _captures(archive: str, content: bytes) -> list[tuple]:
    """The sorted captures of one archive; length and digest of a response are those of its payload as read."""
    data, found = zlib.decompress(content, 31), []
    for headers, at, block, end in parsed(data):
        start = data.index(b"\r\n\r\n", block, end) + 4
        kind = headers["WARC-Type"]
        if kind == "response":
            size, digest = end - start, base64.b32encode(hashlib.sha1(data[start:end]).digest()).decode()
            if headers["WARC-Payload-Digest"] != "sha1:" + digest:
                raise ValueError(f"{archive}: the payload at byte {at} is damaged")
        else:
            size = int(re.search(rb"\r\nContent-Length: (\d+)", data[block:start])[1])
            digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        url = headers["WARC-Target-URI"]
        stamp = re.sub(r"\D", "", headers["WARC-Date"])
        found.append((url_key(url), stamp, _number(headers["WARC-Record-ID"]), size, digest, kind, _number(headers.get("WARC-Refers-To")), url, archive, at, end - at))
    return sorted(found, key=_order)


def capture_runs(spark, path: str) -> DataFrame:
    """A sorted run of captures for each archive, in a written table; the run's name is ``archive``."""

    def run(batches):
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield _table(_captures(archive.rpartition("/")[2], content))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return materialise(map_arrow(files, run, SCHEMA), "op1-runs")


def _table(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, ARROW, strict=True)], schema=ARROW)


def merged(runs: list[list[tuple]]) -> Iterator[tuple]:
    """K-way merge of sorted runs of (key, row) by a tournament tree of losers: each output replays one path."""
    n = len(runs)
    if not n:
        return
    heads = [0] * n

    def before(a: int, b: int) -> bool:
        if heads[b] >= len(runs[b]):
            return True
        return heads[a] < len(runs[a]) and (runs[a][heads[a]][0], a) < (runs[b][heads[b]][0], b)

    losers, winners = [0] * n, [0] * n + list(range(n))
    for k in range(n - 1, 0, -1):
        a, b = winners[2 * k], winners[2 * k + 1]
        winners[k], losers[k] = (a, b) if before(a, b) else (b, a)
    best = winners[1] if n > 1 else 0
    for _ in range(sum(map(len, runs))):
        yield runs[best][heads[best]][1]
        heads[best] += 1
        k = (best + n) // 2
        while k:
            if not before(best, losers[k]):
                best, losers[k] = losers[k], best
            k //= 2


def capture_histories(runs: DataFrame, rows_per_range: int = 200_000) -> DataFrame:
    """All captures in one order of (urlkey, timestamp, page_id): partition after partition, and inside each by a
    merge of the runs that reach it."""
    total = runs.count()
    ranges = max(1, math.ceil(total / rows_per_range), int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def merge(batches):
        by_run: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by_run.setdefault(row[8], []).append((_order(row), row))
        for run in by_run.values():
            run.sort(key=lambda x: x[0])  # a fetched run stands sorted already, for which this is one pass
        out: list[tuple] = []
        for row in merged(list(by_run.values())):
            out.append(row)
            if len(out) == 10_000:
                yield _table(out)
                out = []
        yield _table(out)

    dealt = runs.repartitionByRange(ranges, "urlkey", "timestamp", "page_id", "archive", "offset")
    return map_arrow(dealt, merge, SCHEMA)


def archive(pages: DataFrame, records_per_file: int = 2000, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the pages' archives, read them back and merge their indexes: a row per capture, in global order.

    Columns: urlkey, timestamp, page_id, payload_bytes, payload_digest, record_type, refers_to, url, archive, offset,
    length (the last two in bytes of the unpacked archive).

    A null html is an empty payload, and empty payloads are equal like any others.  A null URL is empty.  A page
    without an id never stands for others: it revisits the largest id with its payload, and is a response where no
    page with that payload has an id.  Rows repeated with one id and payload are written each, with the same type.
    Other columns are not read; an empty table gives no archive and an empty index.  A task holds one archive at a
    time, of at most 128 MB or one page of any length, and one range of the index.
    """
    return capture_histories(capture_runs(pages.sparkSession, write_archives(pages, records_per_file, page, url, html)))
