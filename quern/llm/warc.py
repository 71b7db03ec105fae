"""WARC archives of pages, and their index by an external merge of sorted runs.

Writing: a page is one WARC/1.1 record whose block is an HTTP answer with the
html in UTF-8 as payload. Of equal payloads of REVISIT_FROM bytes or more (by
SHA-256), that of the smallest page_id is a response record and the others are
revisit records without payload that name it. Spark's text writer makes the
files: a record is a row, the blank lines between records are its line separator.

Reading: archives pass through Spark's text reader piece by piece and are parsed
by Content-Length, so that a task holds one record, not one archive; payload
digests are verified. The captures of an archive (RECORDS_PER_FILE at most),
sorted by URL key, time and page_id, are a run. Runs are dealt by ranges of that
order, about RANGE_ROWS captures each by count, ties included; Spark sorts a
range by archive and rank on disk, which lays its parts of the runs one after the
other, and a loser tree merges them with one head a run. That gives capture
histories in global order.

Defined results: null html is an empty payload; a null url has no target URI and
the empty key; of rows with a null page_id none is the record that others
revisit unless no row with that payload has an id, and then all are responses;
rows that repeat a page are responses each; an empty table gives none. Columns
other than page_id, url and html are never read. Pages carry no capture time, so
EPOCH plus page_id seconds stands for it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, short_batches, small_side, stored

REVISIT_FROM = 100
RECORDS_PER_FILE = 5_000
#: Captures that a range of the merge holds, about: what a task keeps in memory, as Arrow columns of narrow rows.
RANGE_ROWS = 100_000
#: Rows of a run that are turned to Python at once when its head is read.
HEAD_ROWS = 64
EPOCH = 1_700_000_000
BROADCAST_REVISITS = 500_000
#: Fixed values of the format.
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
BLANK_LINES = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RUN = "urlkey string, captured string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, record_at long"


def _payloads(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("bytes"), F.sha2(html, 256).alias("digest"))


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of the pages that repeat an earlier payload."""
    narrow = stored(_payloads(pages).where(F.col("bytes") >= REVISIT_FROM).select("page_id", "digest"), "payloads")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n")
    first = small_side(stored(first, "first-payloads", narrow.count()), BROADCAST_REVISITS)  # stored: a payload of many pages skews no join
    return narrow.join(first, "digest").where("NOT page_id <=> refers_to").select("page_id", "digest", "refers_to").distinct()


def _record_id(page: Column) -> Column:
    h = F.md5(F.concat(F.lit("page "), F.coalesce(page.cast("string"), F.lit("-"))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *(x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]), F.lit(">"))


def records(pages: DataFrame) -> DataFrame:
    """One column, record: the text of a page's WARC record without the blank lines after it."""
    again = small_side(stored(revisits(pages), "revisits"), BROADCAST_REVISITS).alias("r")
    p = _payloads(pages).alias("p").join(again, F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("p.digest") == F.col("r.digest")), "left")
    repeat = F.col("r.refers_to").isNotNull()

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value.cast("string"))

    length = F.when(repeat, 0).otherwise(F.col("bytes")) + len(HTTP_HEAD)
    captured = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.coalesce("p.page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(repeat, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("p.page_id"))),
        line("WARC-Date", captured),
        line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("p.digest"))),
        F.when(repeat, line("WARC-Profile", F.lit(REVISIT_PROFILE))),
        F.when(repeat, line("WARC-Refers-To", _record_id(F.col("refers_to")))),
        F.when(repeat, line("X-Refers-To-Page", F.col("refers_to"))),
        line("X-Page-Id", F.col("p.page_id")),
        line("X-Payload-Length", F.col("bytes")),
        F.lit("Content-Type: application/http; msgtype=response"),
        line("Content-Length", length),
    )
    return p.select(F.concat(head, F.lit("\r\n\r\n"), F.lit(HTTP_HEAD), F.when(repeat, "").otherwise(F.col("html"))).alias("record"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Gzipped WARC files below ``path``, of at most RECORDS_PER_FILE records each."""
    records(pages).write.option("lineSep", BLANK_LINES).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


class Parser:
    """Records of an archive whose bytes come piece by piece; keeps what is open of one record."""

    def __init__(self):
        self.at, self.pieces, self.held, self.wanted, self.headers = 0, [], 0, None, {}

    def is_open(self) -> bool:
        """Whether a record has begun and not ended."""
        return self.wanted is not None or bool(b"".join(self.pieces).strip(b"\r\n"))

    def feed(self, piece: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
        """(offset, headers, block) of each record that ``piece`` completes."""
        self.pieces.append(piece)
        self.held += len(piece)
        while self.held and (self.wanted is None or self.held >= self.wanted):
            data = b"".join(self.pieces) if len(self.pieces) > 1 else self.pieces[0]
            if self.wanted is None:
                begin = len(data) - len(data.lstrip(b"\r\n"))  # the blank lines after the record before
                end = data.find(b"\r\n\r\n", begin)
                if end < 0:
                    self.pieces = [data]
                    return
                lines = data[begin:end].decode("utf-8", "surrogateescape").split("\r\n")[1:]
                self.headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
                self.start, self.block = self.at + begin, end + 4
                self.wanted = self.block + int(self.headers["content-length"])
                self.pieces = [data]
            else:
                yield self.start, self.headers, data[self.block : self.wanted]
                self.pieces, self.held, self.at = [data[self.wanted :]], self.held - self.wanted, self.at + self.wanted
                self.wanted = None


def url_key(url: str | None) -> str:
    """Host labels in reverse order, then path and query, in lower case."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return (url or "").lower()
    if not host:
        return (url or "").lower()
    return (",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")).lower()


def _capture(archive: str, at: int, headers: dict[str, str], block: bytes) -> tuple:
    digest, length = headers["warc-payload-digest"].removeprefix("sha256:"), int(headers["x-payload-length"])
    if headers["warc-type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        length = len(payload)
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"{archive} at {at}: the payload does not have its digest")
    page, first, url = headers.get("x-page-id"), headers.get("x-refers-to-page"), headers.get("warc-target-uri")
    return url_key(url), headers["warc-date"], None if page is None else int(page), url, length, digest, headers["warc-type"], None if first is None else int(first), archive, at


def _order(capture: tuple) -> tuple:
    return capture[0].encode("utf-8", "surrogateescape"), capture[1], capture[2] is not None, capture[2] or 0


def _batch(rows: list[tuple], extra: str = "") -> pa.RecordBatch:
    fields = [f.split() for f in (RUN + extra).split(", ")]
    kinds = [pa.int64() if kind == "long" else pa.string() for _, kind in fields]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [name for name, _ in fields])


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of every archive, each archive's sorted, with their rank in it.

    A gzipped file is one split, so a task sees its pieces in order, one file after the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, parser, found = None, Parser(), []

        def sorted_run() -> pa.RecordBatch:
            if parser.is_open():
                raise ValueError(f"{archive} ends inside a record")
            return _batch([(*c, i) for i, c in enumerate(sorted(found, key=_order))], ", rank long")

        for b in batches:
            for name, piece in zip(b.column(0).to_pylist(), b.column(1)):
                if name != archive:
                    if archive is not None:
                        yield sorted_run()
                    archive, parser, found = name, Parser(), []
                found += [_capture(archive, *record) for record in parser.feed(piece.as_py() + BLANK_LINES.encode())]
        if archive is not None:
            yield sorted_run()

    short_batches(spark)
    pieces = spark.read.option("lineSep", BLANK_LINES).text(path).select(F.col("_metadata.file_name").alias("archive"), F.col("value").cast("binary").alias("piece"))
    return pieces.mapInArrow(run, RUN + ", rank long")


class LoserTree:
    """Merge of k sorted runs: an inner node keeps the loser of its match, the overall winner stands on top."""

    def __init__(self, sources: list[Iterable[tuple]], key=_order):
        self.sources, self.key = [iter(s) for s in sources], key
        self.k = len(self.sources)
        self.heads: list = [None] * self.k
        self.keys: list = [None] * self.k
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._read(i)
        for i in range(self.k):
            self._play(i)

    def _read(self, i: int) -> None:
        self.heads[i] = next(self.sources[i], None)
        self.keys[i] = None if self.heads[i] is None else self.key(self.heads[i])

    def _beats(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, i: int) -> None:
        """Run ``i`` climbs from its leaf; while the tree fills, the first to reach a node waits there."""
        node = (i + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = i
                return
            if self._beats(other, i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.tree[0]] is not None:
            winner = self.tree[0]
            yield self.heads[winner]
            self._read(winner)
            self._play(winner)


def _rows(part: pa.Table) -> Iterator[tuple]:
    """The rows of a sorted part of a run, turned to Python a few at a time."""
    for at in range(0, len(part), HEAD_ROWS):
        yield from zip(*(c.to_pylist() for c in part.slice(at, HEAD_ROWS).columns))


def merged(sorted_runs: DataFrame, ranges: int | None = None) -> DataFrame:
    """All captures in global order by URL key, time and page_id: partitions are ranges, in order, sorted inside."""
    n = ranges or 1 + sorted_runs.count() // RANGE_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches) or [_batch([], ", rank long")]).combine_chunks()
        archive = table.column("archive").combine_chunks() if len(table) else pa.array([], pa.string())
        cuts = np.flatnonzero(pc.not_equal(archive[1:], archive[:-1]).to_numpy(zero_copy_only=False)) + 1 if len(table) > 1 else []
        starts = [0, *cuts] if len(table) else []
        out = []
        for row in LoserTree([_rows(table.slice(a, b - a)) for a, b in zip(starts, [*starts[1:], len(table)])]):
            out.append(row[:-1])
            if len(out) == 10_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    # UTF-8 bytes order as the merge does; nulls first in both. The last two columns part ties.
    ranged = sorted_runs.repartitionByRange(n, "urlkey", "captured", "page_id", "archive", "rank")
    return ranged.sortWithinPartitions("archive", "rank").mapInArrow(run, RUN)


def capture_index(pages: DataFrame, path: str) -> DataFrame:
    """Write ``pages`` as archives below ``path``, read them back, and return the merged capture index."""
    write_archives(pages, path)
    return merged(stored(runs(pages.sparkSession, path), "capture-runs"))


def op4_loser_tree_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = capture_index(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared_path(spark, "warc"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op4_loser_tree_warc": op4_loser_tree_warc}
ORACLE_SQL = {
    "op4_loser_tree_warc": f"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {REVISIT_FROM} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= {REVISIT_FROM} AND page_id <> first THEN first END AS refers_to FROM f
"""
}
