"""WARC archives of pages, and a globally ordered index of captures by external merging.

Records are text, so Spark's text sink writes the archives (on any store that Spark writes to) and its binary source
reads them back. Each archive gives one run of captures sorted by URL key and time; key ranges of all runs go to
tasks, which merge their pieces of the runs by a tree of losers.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import parse_qsl, urlencode, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.base import new_path, whole_ids, written

#: Equal payloads of so many bytes or more become revisits; payload bytes of one archive; index rows of one range; payloads
#: that hold this share of the pages or more are common (so there are at most as many of them as the share's inverse).
REVISIT_BYTES, ARCHIVE_BYTES, RANGE_ROWS, COMMON = 100, 32 << 20, 200_000, 1 / 1000
_CRLF = "\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Seconds of the first capture's time where pages have no time of their own, which then follows the id.
_EPOCH = 1_704_067_200


def url_key(url: str | None) -> str:
    """A sortable key: host labels reversed, without a leading www and default port, then path and sorted query, lower-cased."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return (url or "").lower()
    host = re.sub(r"^www\d*\.", "", host)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    query = urlencode(sorted(parse_qsl(parts.query, keep_blank_values=True)))
    return f"{key}){parts.path.lower() or '/'}" + (f"?{query.lower()}" if query else "")


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as row, page_id, url, payload, payload_bytes, payload_digest, repeats, record_type, refers_to.

    row only makes record ids distinct; repeats tells whether the payload has revisits. Common payloads meet their first
    page through a broadcast of bounded size, the others through a join in which no digest has many pages.
    """
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    total = pages.count()
    equal = rows.filter(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    equal = written(equal, "equal")
    common = F.col("n") >= F.lit(max(2.0, total * COMMON))
    hot = equal.filter(common).select("payload_digest", F.col("first").alias("hot_first"), F.lit(True).alias("hot"))
    cold = equal.filter(~common).select(F.col("payload_digest").alias("key"), "first", F.lit(True).alias("cold"))
    rows = rows.join(F.broadcast(hot), "payload_digest", "left")  # 1 / COMMON rows at most
    key = F.when(F.col("hot"), F.concat(F.lit("row "), F.col("row").cast("string"))).otherwise(F.col("payload_digest"))
    rows = rows.withColumn("key", key).join(cold, "key", "left")
    first, repeats = F.when(F.col("hot"), F.col("hot_first")).otherwise(F.col("first")), F.coalesce("hot", "cold", F.lit(False))
    again = repeats & ~first.eqNullSafe(F.col("page_id"))
    return rows.select(
        "row", "page_id", "url", "payload", "payload_bytes", "payload_digest", repeats.alias("repeats"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, first).alias("refers_to"),
    )


def _urn(page: str, tail: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("")), F.lit(":"), tail, F.lit(">"))


def write_archives(pages: DataFrame, path: str, records: int) -> None:
    """Writes with_revisits' rows as gzipped WARC/1.1 files of so many records at most.

    A response that revisits refer to has its page id and the start of its digest as record id, so that a revisit can name
    it; all other records have a row number as well. (Repeated rows of that page and payload share the id.)
    """
    date = F.date_format(F.timestamp_seconds(F.lit(_EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.col("record_type") == "revisit"
    digest = F.substring("payload_digest", 1, 16)
    own = F.when(F.col("repeats") & ~revisit, digest).otherwise(F.concat_ws("-", digest, F.col("row").cast("string")))
    body = F.when(revisit, _HTTP).otherwise(F.concat(F.lit(_HTTP), "payload"))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    fields = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: "), _urn("page_id", own)),
        F.concat(F.lit("WARC-Date: "), date),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), "payload_digest"),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _urn("refers_to", digest))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    record = F.concat(F.concat_ws(_CRLF, *fields), F.lit(_CRLF * 2), body, F.lit(_CRLF)).alias("value")
    pages.select(record).write.option("lineSep", _CRLF).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def records_of(data: bytes) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """(offset, length, fields by lower-case name, block) of the records of one archive."""
    view, at = memoryview(data), 0
    while at < len(data):
        top = data.index(b"\r\n\r\n", at)
        lines = data[at:top].decode().split(_CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        start = top + 4
        end = start + int(fields["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"no end of the record at byte {at}")
        yield at, end + 4 - at, fields, view[start:end]
        at = end + 4


_RUN = "run string, urlkey string, ts string, offset long, length long, page_id {id}, payload_bytes long, payload_digest string, record_type string, refers_to {id}"


def _page(urn: str | None, text: bool):
    value = urn.split(":", 2)[2].rpartition(":")[0] if urn else ""
    return (value if text else int(value)) if value else None


def _runs(id_type: pa.DataType):
    names = [x.split()[0] for x in _RUN.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), id_type, pa.int64(), pa.string(), pa.string(), id_type]
    text = pa.types.is_string(id_type)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                run, path = [], path.as_py()
                for offset, length, fields, block in records_of(gzip.decompress(content.as_py())):
                    digest, size = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["warc-payload-length"])
                    if fields["warc-type"] == "response":
                        payload = bytes(block).split(b"\r\n\r\n", 1)[1]
                        if (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                            raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
                    page = _page(fields["warc-record-id"], text)
                    run.append((path, url_key(fields.get("warc-target-uri")), fields["warc-date"], offset, length, page, size, digest, fields["warc-type"], _page(fields.get("warc-refers-to"), text)))
                run.sort(key=lambda r: (r[1], r[2], r[3]))
                cols = list(zip(*run, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return work


def capture_runs(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Captures in the archives below path, each archive's as a run sorted by URL key, time and offset; payloads are held against their digests."""
    arrow_id = pa.string() if id_type == "string" else pa.int32() if id_type == "int" else pa.int64()
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_runs(arrow_id), _RUN.format(id=id_type))


class LoserTree:
    """Merges sorted runs: inner nodes hold the loser of each match, the winner moves up; one path is replayed for each item."""

    def __init__(self, runs: list[list]):
        self._heads = [iter(r) for r in runs]
        self._now = [next(h, None) for h in self._heads]
        k = len(runs)
        self._tree = [-1] * max(k, 1)
        for leaf in range(k):
            self._play(leaf, first=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._now[a], self._now[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, leaf: int, first: bool = False) -> None:
        k, winner = len(self._now), leaf
        node = (leaf + k) >> 1
        while node:
            other = self._tree[node]
            if other < 0 and first:
                self._tree[node] = winner
                return
            if self._beats(other, winner):
                self._tree[node], winner = winner, other
            node >>= 1
        self._tree[0] = winner

    def __iter__(self) -> Iterator:
        while self._now and (item := self._now[self._tree[0]]) is not None:
            yield item
            w = self._tree[0]
            self._now[w] = next(self._heads[w], None)
            self._play(w)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges one range: its pieces of the runs come one after the other, each sorted."""
    parts = list(batches)
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    runs: dict[str, list] = {}
    for key in zip(*(table.column(c).to_pylist() for c in ("urlkey", "ts", "run", "offset")), range(table.num_rows), strict=True):
        runs.setdefault(key[2], []).append(key)
    order = [key[4] for key in LoserTree(list(runs.values()))]
    at = TaskContext.get().partitionId()
    out = table.take(pa.array(order, pa.int64()))
    out = out.append_column("range_no", pa.array([at] * len(order), pa.int32())).append_column("range_pos", pa.array(range(len(order)), pa.int64()))
    yield from out.to_batches()


def merged_index(runs: DataFrame) -> DataFrame:
    """runs as capture histories: range_no and range_pos number the captures in order of URL key, time, archive and offset.

    Ranges hold about RANGE_ROWS captures, however many there are; Spark's external sort lays each range's pieces of the
    runs one after the other.
    """
    runs = written(runs, "runs")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema) + ", range_no int, range_pos long"
    ranges = max(1, -(-runs.count() // RANGE_ROWS), int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = runs.repartitionByRange(ranges, "urlkey", "ts", "run", "offset").sortWithinPartitions("run", "urlkey", "ts", "offset")
    return ranged.mapInArrow(_merged, schema)


def archive(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the pages as WARC files below path (by default in the shared folder), reads them back and merges the index.

    One row for each row of pages: page_id, payload_bytes, payload_digest, record_type, refers_to, and the capture's
    place (run, urlkey, ts, offset, length, range_no, range_pos). A null html is an empty payload, a null url has an
    empty host; places are in the unzipped archive. Repeated rows with the smallest page_id of their payload are all responses. A null page_id counts as
    larger than any other; ids are whole numbers, others are refused. Other columns are ignored; an empty table gives no rows.
    """
    whole_ids(pages, id_col)
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    mean = pages.agg(F.avg(F.octet_length(html_col)).alias("mean")).first()["mean"] or 0
    write_archives(with_revisits(pages, id_col, url_col, html_col), path, max(1, int(ARCHIVE_BYTES / (mean + 500))))
    return merged_index(capture_runs(spark, path, pages.schema[id_col].dataType.simpleString()))
