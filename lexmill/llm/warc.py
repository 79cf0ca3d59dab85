"""WARC: records from files, and resolution of not-modified revisits.

`records` parses files (path, content), plain or gzip by record; `read_warc` brings them from a folder. A file is held whole by the
task that reads it, its records one at a time. A file that is no WARC, or ends early, gives its records before the fault and one of type `error`.

A revisit record of the profile server-not-modified has no body: it stands for the latest earlier full response of the same
canonical URL, if that one's validators agree. The as-of join sorts records by URL and time over range partitions, which bound
their rows by sampling, so a URL that has a third of all captures is spread over many. A partition reduces each of its URLs to the
last full response, which later partitions carry on; within a partition, rows are ordered by time. A response that answers a
share of all revisits is brought to them by `lookup`, not to one task.

The headers of a resolved record are those of the stored response, with those that a 304 answer may carry replaced by the revisit's.
Outcomes: `resolved`, `validator mismatch` (an ETag, or else a Last-Modified, differs), `no validator` (neither side shares
one), `no earlier response`. Full responses are returned with outcome `response`, naming themselves; other records, revisits of
another profile among them, with `other`. Records without URL or time find nothing. At equal times the response with the greater
record_id that is still smaller than the revisit's counts as earlier. Repeated rows each give a row; of responses that repeat
record_id, URL and time with other headers or digests, the one with the least hash counts. Header names are compared without
case; the last of repeated names counts; blocks of any length are read, in n log n. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from .common import checkpoint, lookup, materialize

NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
#: Headers that a 304 answer may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Bytes of records that make a file of `archive` full.
FILE = 4 << 20


def canonical_url(url: Column) -> Column:
    """Host in lower case without scheme, www, default port, fragment, tracking parameters and a slash at the end."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|ref|gclid|fbclid)(=|$)")), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def header_map(block: Column) -> Column:
    """A block of header lines as a map by lower-case name; the last of repeated names counts."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), "\r?\n"), lambda x: x.rlike(r"^[^:\s]+:"))
    pairs = F.array_sort(F.transform(lines, lambda x, i: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("k"), i.alias("i"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v"))))
    last = let(pairs, lambda p: F.filter(p, lambda x, i: ~F.coalesce(F.get(p, i + 1)["k"] == x["k"], F.lit(False))))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"])))


def header_text(headers: Column) -> Column:
    """A map of headers as lines, by name."""
    entries = F.array_sort(F.map_entries(headers))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """records: record_id bigint, warc_type, uri, at (timestamp), http_headers (lines), payload_digest. A row for each record."""
    rows = records.select(
        F.col("record_id").cast("bigint"), "warc_type", canonical_url(F.col("uri")).alias("url"), F.col("at").cast("timestamp"),
        header_map(F.col("http_headers")).alias("headers"), "payload_digest", F.xxhash64("http_headers", "payload_digest").alias("tie"),
    )
    rows = checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))
    full = F.when(F.col("warc_type") == "response", F.struct("at", "record_id"))
    keys = rows.filter("url IS NOT NULL AND at IS NOT NULL").select("row", "record_id", "warc_type", "url", "at", full.alias("full"))
    ranged = keys.repartitionByRange("url", "at", "record_id").withColumn("block", F.spark_partition_id())
    ranged = materialize(ranged, "captures")
    within = Window.partitionBy("url", "block").orderBy("at", "record_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.groupBy("url", "block").agg(F.max("full").alias("end"))
    before = Window.partitionBy("url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("url", "block", F.last("end", True).over(before).alias("carried"))
    own = ranged.withColumn("own", F.last("full", True).over(within)).filter("warc_type = 'revisit'")
    found = own.join(carried.hint("merge"), ["url", "block"]).select("row", "url", F.coalesce("own", "carried").alias("source"))
    source = F.struct(F.col("source.record_id").alias("source_id"), "url", F.col("source.at").alias("source_at"))
    pairs = checkpoint(found.filter("source IS NOT NULL").select("row", source.alias("source")))
    # A response may answer a third of all revisits.
    uses = pairs.groupBy("source").agg(F.count("*").alias("uses"))
    first = lambda name: F.min_by(name, "tie").alias(f"stored_{name}")
    responses = rows.filter("warc_type = 'response'").select(F.struct(F.col("record_id").alias("source_id"), "url", F.col("at").alias("source_at")).alias("source"), "tie", "headers", "payload_digest")
    stored = responses.join(uses.hint("merge"), "source").groupBy("source", "uses").agg(first("headers"), first("payload_digest"))
    answered = lookup(pairs, checkpoint(stored), "source", "uses", max(1, pairs.count()))
    answered = answered.select("row", F.col("source.source_id").alias("source_id"), F.col("stored_headers").alias("stored"), F.col("stored_payload_digest").alias("stored_digest"))
    joined = rows.join(answered.hint("merge"), "row", "left")

    validator = lambda name: (F.col("headers")[name], F.col("stored")[name])
    (etag, stored_etag), (modified, stored_modified) = validator("etag"), validator("last-modified")
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    outcome = (
        F.when(F.col("warc_type") == "response", "response")
        .when(F.col("warc_type") != "revisit", "other")
        .when(F.col("source_id").isNull(), "no earlier response")
        .when(etag.isNotNull() & stored_etag.isNotNull(), F.when(weak(etag) == weak(stored_etag), "resolved").otherwise("validator mismatch"))
        .when(modified.isNotNull() & stored_modified.isNotNull(), F.when(modified == stored_modified, "resolved").otherwise("validator mismatch"))
        .otherwise("no validator")
    )
    permitted = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("stored", lambda k, v: ~F.array_contains(F.map_keys(permitted), k)), permitted)
    done = F.col("outcome") == "resolved"
    return joined.withColumn("outcome", outcome).select(
        "record_id",
        "url",
        "warc_type",
        "outcome",
        F.when(done, F.col("source_id")).when(F.col("outcome") == "response", F.col("record_id")).alias("source_id"),
        F.when(done, F.col("stored_digest")).when(F.col("outcome") == "response", F.col("payload_digest")).alias("payload_digest"),
        header_text(F.when(done, merged).otherwise(F.col("headers"))).alias("headers"),
    )


def parse_warc(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, plain or gzip by record: warc headers by lower-case name, HTTP head as text, body as bytes, place in the plain file."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    at = 0
    while line := stream.readline():
        if not line.strip():
            at += len(line)
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        begin, warc = at, {}
        at += len(line)
        while (line := stream.readline()).strip():
            at += len(line)
            name, _, value = line.decode("utf-8", "replace").partition(":")
            warc[name.strip().lower()] = value.strip()
        size = int(warc.get("content-length", 0))
        body = stream.read(size)
        if len(body) < size:
            raise ValueError(f"record at byte {begin} is cut off")
        at += len(line) + size
        head, _, rest = body.partition(b"\r\n\r\n") if warc.get("content-type", "").startswith("application/http") else (b"", b"", body)
        yield {"warc": warc, "http_headers": head.decode("latin-1"), "body": rest, "offset": begin, "length": at - begin}


PARSED = "path string, record_offset bigint, record_length bigint, name string, warc_type string, uri string, date string, profile string, http_headers string, payload_digest string, body_length bigint, body binary"


def records(files: DataFrame, bodies: bool = False) -> DataFrame:
    """A row for each record of files (path, content): its place, and the columns that resolve_revisits reads; with bodies also what it holds.

    record_id is the number of a WARC-Record-ID <urn:record:number>, or else the hash of the whole id.
    """
    names = [part.split()[0] for part in PARSED.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64()] + [pa.string()] * 7 + [pa.int64(), pa.binary()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns):
                out, held = [], 0
                for row in _rows(path.as_py(), content.as_py() or b"", bodies):
                    out.append(row)
                    held += len(row[8] or "") + len(row[11] or b"")
                    if len(out) >= 5000 or held > 32 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    found = files.select("path", "content").mapInArrow(rows, PARSED)
    number = F.regexp_extract(F.coalesce("name", F.lit("")), r"^<urn:record:(\d{1,18})>$", 1)
    kind = F.when((F.col("warc_type") == "revisit") & ~F.coalesce(F.col("profile"), F.lit(NOT_MODIFIED)).endswith("server-not-modified"), "revisit of another profile")
    columns = [
        F.when(number != "", number.cast("bigint")).otherwise(F.xxhash64("name")).alias("record_id"), F.coalesce(kind, "warc_type").alias("warc_type"), "uri",
        F.try_to_timestamp("date", F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]X")).alias("at"), "http_headers", "payload_digest", "path", "record_offset", "record_length", "body_length",
    ]
    return found.select(*columns, *["body"] * bodies)


def _rows(path: str, data: bytes, bodies: bool) -> Iterator[tuple]:
    try:
        for r in parse_warc(data):
            w = r["warc"]
            kept = [w.get(k) for k in ("warc-record-id", "warc-type", "warc-target-uri", "warc-date", "warc-profile")]
            yield (path, r["offset"], r["length"], *kept, r["http_headers"], w.get("warc-payload-digest"), len(r["body"]), r["body"] if bodies else None)
    except (ValueError, EOFError, OSError, zlib.error) as fault:
        yield (path, None, None, None, "error", None, None, None, str(fault), None, None, None)


def read_warc(spark: SparkSession, path: str, bodies: bool = False) -> DataFrame:
    """The records of the WARC files under path."""
    return records(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc*").load(path), bodies)


def archive(captures: DataFrame, size: int = FILE) -> DataFrame:
    """captures (record_id, warc_type, uri, date, http_headers, payload_digest, body) as files of WARC records: path, content."""

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, length = TaskContext.get().partitionId(), 0, [], 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{number:06d}.warc"]), pa.array([b"".join(held)], pa.binary())], names=["path", "content"])

        for batch in batches:
            for row in batch.to_pylist():
                held.append(_record(**row))
                length += len(held[-1])
                if length >= size:
                    yield full()
                    number, held, length = number + 1, [], 0
        if held:
            yield full()

    names = ["record_id", "warc_type", "uri", "date", "http_headers", "payload_digest", "body"]
    return captures.select(*names).mapInArrow(files, "path string, content binary")


def _record(record_id: int, warc_type: str, uri: str | None, date: str | None, http_headers: str, payload_digest: str | None, body: str | None) -> bytes:
    revisit = warc_type == "revisit"
    http = f"HTTP/1.1 {'304 Not Modified' if revisit else '200 OK'}\r\n{http_headers}\r\n".encode("latin-1", "replace") + (body or "").encode()
    fields = [
        ("WARC-Type", warc_type), ("WARC-Record-ID", f"<urn:record:{record_id}>"), ("WARC-Target-URI", uri), ("WARC-Date", date),
        ("WARC-Profile", NOT_MODIFIED if revisit else None), ("WARC-Payload-Digest", payload_digest), ("Content-Type", "application/http"), ("Content-Length", len(http)),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + http + b"\r\n\r\n"


def captures(pages: DataFrame) -> DataFrame:
    """A capture history of a table of pages: each page in full, a not-modified answer with its ETag, and one of five others.

    By page_id these are: another ETag; its Last-Modified alone; no validator; an answer from before all pages; another Last-Modified.
    Every seventh page was stored without an ETag. Pages of one canonical URL share a history. Times follow page_id.
    """
    page, none = F.col("page_id"), F.lit(None).cast("string")
    html = F.coalesce("html", F.lit(""))
    etag = F.concat(F.lit('"'), F.md5(html.cast("binary")), F.lit('"'))
    digest = F.concat(F.lit("sha256:"), F.sha2(html.cast("binary"), 256))
    number = page.cast("string")
    turn = F.pmod(page, F.lit(5))
    stamp = lambda seconds: F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    modified = F.concat(F.lit("page "), number)
    lines = lambda *pairs: F.concat(*[F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")), F.lit("")) for k, v in pairs])
    text = lambda x: F.lit(x)
    response = lines(
        ("Content-Type", text("text/html")), ("ETag", F.when(F.pmod(page, F.lit(7)) != 0, etag)), ("Last-Modified", modified),
        ("Content-Length", F.length(html).cast("string")), ("Cache-Control", text("max-age=60")), ("Server", text("first")),
    )
    same = lines(("ETag", F.concat(F.lit("W/"), etag)), ("Cache-Control", F.concat(F.lit("max-age="), number)), ("Server", text("second")))
    other = lines(
        ("ETag", F.when(turn == 0, F.concat(F.lit('"'), number, F.lit('"'))).when(turn == 3, etag)),
        ("Last-Modified", F.when(turn == 1, modified).when(turn == 4, text("never"))), ("Expires", text("0")),
    )
    early = F.when(turn == 3, page * 60 - 400_000_000).otherwise(page * 60 + 216_000)
    kinds = [("response", page * 60, response, digest, html), ("revisit", page * 60 + 108_000, same, none, none), ("revisit", early, other, none, none)]
    rows = [F.struct((page * 3 + k).alias("record_id"), F.lit(kind).alias("warc_type"), F.col("url").alias("uri"), stamp(at).alias("date"), head.alias("http_headers"), sha.alias("payload_digest"), body.alias("body")) for k, (kind, at, head, sha, body) in enumerate(kinds)]
    return pages.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' history is written as WARC files, these are parsed, and their revisits resolved."""
    files = materialize(archive(captures(spark.read.parquet(f"{sf_dir}/pages.parquet"))), "warc")
    return resolve_revisits(records(files))


#: DuckDB SQL for op10_warc.
ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, md5(coalesce(html, '')) AS tag, 'sha256:' || sha256(coalesce(html, '')) AS digest, length(coalesce(html, '')) AS n,
         regexp_replace(trim(url), '#.*$', '') AS bare
  FROM pages
), q AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
         regexp_replace(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS path,
         array_to_string(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)')), '&') AS kept
  FROM p
), u AS (
  SELECT *, CASE WHEN host <> '' THEN host || path || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS url FROM q
), r AS (
  SELECT page_id * 3 AS record_id, 'response' AS warc_type, url, page_id * 60 AS seen, CASE WHEN page_id % 7 <> 0 THEN '"' || tag || '"' END AS etag,
         'page ' || page_id AS modified, digest, 'max-age=60' AS cache, n, 'text/html' AS kind, NULL AS expires, 'first' AS server FROM u
  UNION ALL
  SELECT page_id * 3 + 1, 'revisit', url, page_id * 60 + 108000, 'W/"' || tag || '"', NULL, NULL, 'max-age=' || page_id, NULL, NULL, NULL, 'second' FROM u
  UNION ALL
  SELECT page_id * 3 + 2, 'revisit', url, CASE WHEN page_id % 5 = 3 THEN page_id * 60 - 400000000 ELSE page_id * 60 + 216000 END,
         CASE page_id % 5 WHEN 0 THEN '"' || page_id || '"' WHEN 3 THEN '"' || tag || '"' END, CASE page_id % 5 WHEN 1 THEN 'page ' || page_id WHEN 4 THEN 'never' END,
         NULL, NULL, NULL, NULL, '0', NULL FROM u
), s AS (
  SELECT *, last_value(CASE WHEN warc_type = 'response' THEN record_id END IGNORE NULLS)
              OVER (PARTITION BY url ORDER BY seen, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS source
  FROM r
), t AS (
  SELECT s.*, f.record_id AS stored, f.etag AS stored_etag, f.modified AS stored_modified, f.digest AS stored_digest, f.n AS stored_n, f.cache AS stored_cache
  FROM s LEFT JOIN r f ON f.record_id = s.source AND s.warc_type = 'revisit' AND s.url IS NOT NULL
), o AS (
  SELECT *, CASE WHEN warc_type = 'response' THEN 'response' WHEN stored IS NULL THEN 'no earlier response'
                 WHEN etag IS NOT NULL AND stored_etag IS NOT NULL
                 THEN CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(stored_etag, '^W/', '') THEN 'resolved' ELSE 'validator mismatch' END
                 WHEN modified IS NOT NULL AND stored_modified IS NOT NULL THEN CASE WHEN modified = stored_modified THEN 'resolved' ELSE 'validator mismatch' END
                 ELSE 'no validator' END AS outcome
  FROM t
), h AS (
  SELECT *, outcome = 'resolved' AS done FROM o
)
SELECT record_id, url, warc_type, outcome,
       CASE outcome WHEN 'resolved' THEN source WHEN 'response' THEN record_id END AS source_id,
       CASE outcome WHEN 'resolved' THEN stored_digest WHEN 'response' THEN digest END AS payload_digest,
       array_to_string(list_filter([
         'cache-control: ' || CASE WHEN done THEN coalesce(cache, stored_cache) ELSE cache END,
         'content-length: ' || CASE WHEN done THEN stored_n ELSE n END,
         'content-type: ' || CASE WHEN done THEN 'text/html' ELSE kind END,
         'etag: ' || CASE WHEN done THEN coalesce(etag, stored_etag) ELSE etag END,
         'expires: ' || expires,
         'last-modified: ' || CASE WHEN done THEN stored_modified ELSE modified END,
         'server: ' || CASE WHEN done THEN 'first' ELSE server END
       ], lambda x: x IS NOT NULL), chr(10)) AS headers
FROM h
"""
