"""WARC revisit resolution: headers are shuffled by payload digest, payloads never.

A record is a row of `record_id, warc_type, uri, date, digest, refers_to_uri, refers_to_date, content_type, payload`.
The first response of a digest, by date, then record id, is its original. Any later response of the digest
and any revisit record becomes a revisit of that original, with fresh headers; the original and all other
responses are written whole, with fresh headers. Archives are written by Spark's own text writer, a record a
line that ends as records do, so that its commit protocol covers tasks that run twice, on any file system; they
are read as streams, a record at a time, through pyarrow's file systems.

The query takes each page as four captures on different days: two responses, a revisit, and a revisit of a
payload that nobody has. It resolves them, writes the archives, and returns the records read back from them.

Defined results:
- a revisit whose digest no response has stays as it is, `resolved` false; its own Refers-To lines are kept;
- a null digest matches nothing: a response stays whole, a revisit stays unresolved;
- a null payload is an empty one; a null type counts as `response`; null uri and date become empty values;
- line breaks within a value of a header become a blank; payloads of any length are written whole;
- rows with the same record id, digest and type are one record, written once: the least by uri, date and payload;
- ties in date: the least record id is the original;
- a bad Content-Length, or an archive that breaks off, gives a row of type `invalid` with an `error`, and reading goes on
  where the next record starts; such rows are passed through by `resolve_revisits` like any type it doesn't know;
- an empty table gives an empty archive; further columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import cut, scratch

#: Digests with several records are broadcast up to this many rows (about 200 bytes each); beyond it they are joined by a shuffle.
BROADCAST_DIGESTS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, warc_type string, uri string, date string, digest string, refers_to_uri string, refers_to_date string, content_type string, payload binary"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
HTTP, HEAD = "application/http; msgtype=response", "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = "\r\n\r\n"


def page_records(pages: DataFrame) -> DataFrame:
    """Four captures of each page: two responses, a revisit, and a revisit of a payload that isn't there. Ids follow from page_id, url, payload and the capture's number."""
    hexed = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    base = pages.select("page_id", "url", "html", hexed.alias("_x"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("_k"))
    h = F.sha2(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.coalesce("url", F.lit("-")), "_x", F.col("_k").cast("string")).cast("binary"), 256)
    uuid = F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    day = F.lpad((F.pmod(F.col("page_id") * 7 + F.col("_k") * 11, F.lit(28)) + 1).cast("string"), 2, "0")
    none = F.lit(None).cast("string")
    return base.select(
        F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">")).alias("record_id"), F.when(F.col("_k") < 2, "response").otherwise("revisit").alias("warc_type"), F.col("url").alias("uri"),
        F.concat(F.lit("2026-01-"), day, F.lit("T00:00:00Z")).alias("date"), F.concat(F.lit("sha256:"), F.when(F.col("_k") < 3, F.col("_x")).otherwise(F.sha2(F.concat(F.lit("gone "), "_x").cast("binary"), 256))).alias("digest"),
        none.alias("refers_to_uri"), none.alias("refers_to_date"), none.alias("content_type"), F.when(F.col("_k") < 2, F.concat(F.lit(HEAD), F.coalesce("html", F.lit("")))).alias("payload"),
    )  # fmt: skip


def _once(records: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of a record that comes several times (`keys` has these) become one; all others don't move."""
    if keys.isEmpty():
        return records
    at = [F.col("record_id").eqNullSafe(F.col("_r")), F.col("digest").eqNullSafe(F.col("_d")), F.coalesce("warc_type", F.lit("response")) == F.col("_t")]
    load = F.sha2(F.col("payload").cast("binary"), 256)
    least = F.min_by(F.struct(*records.columns), F.struct("uri", "date", load, "refers_to_uri", "refers_to_date", "content_type")).alias("_row")
    again = records.join(keys, at, "left_semi").groupBy("record_id", "digest", F.coalesce("warc_type", F.lit("response"))).agg(least).select("_row.*")
    return records.join(keys, at, "left_anti").unionByName(again)


def resolve_revisits(records: DataFrame, broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """All records, with their new warc_type, refers_to_id, _uri and _date, resolved (null for responses), and the fresh header."""
    records = records.select(*_NAMES)
    heads = records.select("record_id", "uri", "date", "digest", F.coalesce("warc_type", F.lit("response")).alias("warc_type"))
    one = cut(heads.groupBy("digest", "record_id", "warc_type").agg(F.min(F.struct("uri", "date")).alias("_f"), F.count("*").alias("n")).select("digest", "record_id", "warc_type", "_f.*", "n"))
    keys = one.where("n > 1").select(F.col("record_id").alias("_r"), F.col("digest").alias("_d"), F.col("warc_type").alias("_t"))
    first = F.min(F.when(F.col("warc_type") == "response", F.struct(F.coalesce("date", F.lit("")).alias("d"), "record_id", "uri")))
    groups = one.where("digest IS NOT NULL").groupBy("digest").agg(first.alias("_o"), F.count("*").alias("_n")).where("_n > 1 AND _o IS NOT NULL")
    groups = cut(groups.select(F.col("digest").alias("_digest"), "_o"))
    small = F.broadcast(groups) if groups.count() <= broadcast_digests else groups.hint("merge")
    joined = _once(records, keys).join(small, F.col("digest") == F.col("_digest"), "left")
    old = F.coalesce("warc_type", F.lit("response"))
    revisit = (old == "revisit") | (F.col("_o").isNotNull() & (F.col("_o.record_id") != F.col("record_id")) & (old == "response"))
    pick = lambda new, own: F.when(revisit, F.coalesce(new, own))  # noqa: E731
    kind = F.when(revisit, None).otherwise(F.coalesce("content_type", F.when(old == "response", HTTP).when(old == "warcinfo", "application/warc-fields").otherwise("application/octet-stream")))
    out = joined.withColumns({
        "_type": F.when(revisit, "revisit").otherwise(old), "resolved": F.when(revisit, F.col("_o").isNotNull()),
        "refers_to_id": F.when(revisit, F.col("_o.record_id")), "_u": pick(F.col("_o.uri"), F.col("refers_to_uri")), "_at": pick(F.nullif(F.col("_o.d"), F.lit("")), F.col("refers_to_date")),
        "_kind": kind, "_length": F.when(revisit, F.lit(0)).otherwise(F.coalesce(F.octet_length("payload"), F.lit(0))),
    })  # fmt: skip
    line = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(name + ": "), F.regexp_replace(c, r"[\r\n]+", " "), F.lit("\r\n"))).otherwise("")  # noqa: E731
    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("_type")), line("WARC-Record-ID", F.coalesce("record_id", F.lit(""))), line("WARC-Date", F.coalesce("date", F.lit(""))),
        line("WARC-Target-URI", F.coalesce("uri", F.lit(""))), line("WARC-Payload-Digest", F.col("digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\n"), line("WARC-Refers-To", F.col("refers_to_id")), line("WARC-Refers-To-Target-URI", F.col("_u")), line("WARC-Refers-To-Date", F.col("_at")))).otherwise(""),
        line("Content-Type", F.col("_kind")), line("Content-Length", F.col("_length").cast("string")), F.lit("\r\n"),
    )  # fmt: skip
    empty = F.lit("").cast(records.schema["payload"].dataType)
    return out.select(
        "record_id", F.col("_type").alias("warc_type"), "uri", "date", "digest", "resolved", "refers_to_id", F.col("_u").alias("refers_to_uri"), F.col("_at").alias("refers_to_date"),
        header.alias("header"), F.when(revisit, empty).otherwise(F.coalesce("payload", empty)).alias("payload"),
    )  # fmt: skip


class _Stream:
    """An archive's bytes from the front, unpacked if it is gzipped (in one member or many); holds what is asked for, and a piece more."""

    def __init__(self, read: Callable[[int], bytes]):
        self.read, self.held, self.done, self.broken = read, bytearray(), False, False
        first = read(1 << 16)
        self.zip = zlib.decompressobj(31) if first[:2] == b"\x1f\x8b" else None
        self._take(first)

    def _take(self, data: bytes) -> None:
        if not data:
            self.done = True
            self.broken |= self.zip is not None and not self.zip.eof
        elif self.zip is None:
            self.held += data
        else:
            while data:
                if self.zip.eof:
                    if not data.startswith(b"\x1f\x8b"):
                        self.done = self.broken = True
                        return
                    self.zip = zlib.decompressobj(31)
                try:
                    self.held += self.zip.decompress(data)
                except zlib.error:
                    self.done = self.broken = True
                    return
                data = self.zip.unused_data

    def fill(self, n: int) -> bool:
        while len(self.held) < n and not self.done:
            self._take(self.read(1 << 20))
        return len(self.held) >= n

    def find(self, what: bytes, at: int = 0) -> int:
        """Where it is, -1 if nowhere."""
        while True:
            if (k := self.held.find(what, at)) >= 0 or self.done:
                return k
            at = max(at, len(self.held) - len(what) + 1)
            self.fill(len(self.held) + 1)

    def skip(self, n: int) -> None:
        del self.held[:n]


def _parse(read: Callable[[int], bytes]) -> Iterator[tuple]:
    """Of each record: SCHEMA's columns, refers_to_id, header, error."""
    s = _Stream(read)
    bad = lambda why: (None, "invalid", *[None] * 7, None, None, why)  # noqa: E731
    while True:
        at = s.find(b"WARC/")
        if at < 0:
            break
        s.skip(at)
        end = s.find(END.encode())
        if end < 0:
            yield bad("a header without an end")
            return
        head = bytes(s.held[: end + 4])
        h: dict[bytes, str] = {}
        for x in head[:end].split(b"\r\n")[1:]:
            name, _, value = x.partition(b":")
            h[name.strip().lower()] = value.strip().decode("utf-8", "replace")
        size = h.get(b"content-length", "0")
        if not (size.isascii() and size.isdigit()):
            yield bad(f"Content-Length is {size[:100]!r}")
            s.skip(5)
            continue
        n = int(size)
        if not s.fill(len(head) + n):
            yield bad(f"{len(s.held) - len(head)} of {n} bytes are there")
            s.skip(5)
            continue
        get = h.get
        yield (
            get(b"warc-record-id"), get(b"warc-type"), get(b"warc-target-uri"), get(b"warc-date"), get(b"warc-payload-digest"), get(b"warc-refers-to-target-uri"), get(b"warc-refers-to-date"),
            get(b"content-type"), bytes(s.held[len(head) : len(head) + n]), get(b"warc-refers-to"), head.decode("utf-8", "replace"), None,
        )  # fmt: skip
        s.skip(len(head) + n)
    if s.broken:
        yield bad("the archive breaks off")


def _open(path: str):
    if path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_stream("/" + path[5:].lstrip("/"), compression=None)
    fs, at = pafs.FileSystem.from_uri(path)
    return fs.open_input_stream(at, compression=None)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives at path, plain or gzipped: SCHEMA's columns, refers_to_id, header (as it stands there) and error."""
    names = [*_NAMES, "refers_to_id", "header", "error"]
    kinds = [pa.string()] * 8 + [pa.binary()] + [pa.string()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)  # noqa: E731
        for b in batches:
            for name in b.column(0).to_pylist():
                with _open(name) as f:
                    for r in _parse(f.read):
                        rows.append(r)
                        size += len(r[8] or b"") + 1000
                        if size > 1 << 24:
                            yield out()
                            rows, size = [], 0
        if rows:
            yield out()

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInArrow(run, f"{SCHEMA}, refers_to_id string, header string, error string")


def write_warc(resolved: DataFrame, folder: str) -> None:
    """Writes what resolve_revisits gave as archives, each gzipped as a whole, into a new folder."""
    record: Column = F.concat(F.col("header").cast("binary"), F.coalesce(F.col("payload").cast("binary"), F.lit(b"")))
    resolved.select(record.cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip").text(folder)


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives stay in the shared folder, as the result is read from them."""
    folder = scratch(spark, "warc")
    write_warc(resolve_revisits(page_records(spark.read.parquet(f"{sf_dir}/pages.parquet"))), folder)
    return read_warc(spark, folder).withColumn("payload", F.col("payload").cast("string")).drop("error")


SQL = rf"""
WITH d AS (SELECT page_id, url, html, sha256(coalesce(html, '')) AS hex, unnest(range(0, 4)) AS k FROM pages),
h AS (SELECT *, sha256(concat_ws('|', coalesce(CAST(page_id AS VARCHAR), '-'), coalesce(url, '-'), hex, CAST(k AS VARCHAR))) AS x FROM d),
r AS (SELECT DISTINCT '<urn:uuid:' || concat_ws('-', substr(x, 1, 8), substr(x, 9, 4), substr(x, 13, 4), substr(x, 17, 4), substr(x, 21, 12)) || '>' AS record_id, k,
  url AS uri, '2026-01-' || lpad(CAST(((page_id * 7 + k * 11) % 28 + 28) % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00Z' AS date,
  'sha256:' || CASE WHEN k < 3 THEN hex ELSE sha256('gone ' || hex) END AS digest, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS payload FROM h),
o AS (SELECT digest, arg_min(struct_pack(i := record_id, u := uri, a := date), (coalesce(date, ''), record_id)) AS o FROM r WHERE k < 2 GROUP BY 1),
t AS (SELECT r.*, o, k > 1 OR o.i <> record_id AS v, regexp_replace(coalesce(uri, ''), '[
]+', ' ', 'g') AS u, regexp_replace(o.u, '[
]+', ' ', 'g') AS ou, coalesce(date, '') AS a, CASE WHEN o.a <> '' THEN o.a END AS oa FROM r LEFT JOIN o USING (digest))
SELECT record_id, CASE WHEN v THEN 'revisit' ELSE 'response' END AS warc_type, u AS uri, a AS date, digest, CASE WHEN v THEN o.i END AS refers_to_id, CASE WHEN v THEN ou END AS refers_to_uri, CASE WHEN v THEN oa END AS refers_to_date,
  CASE WHEN NOT v THEN '{HTTP}' END AS content_type,
  'WARC/1.1' || e || 'WARC-Type: ' || CASE WHEN v THEN 'revisit' ELSE 'response' END || e || 'WARC-Record-ID: ' || record_id || e || 'WARC-Date: ' || a || e
  || 'WARC-Target-URI: ' || u || e || 'WARC-Payload-Digest: ' || digest || e
  || CASE WHEN v THEN 'WARC-Profile: {PROFILE}' || e || coalesce('WARC-Refers-To: ' || o.i || e, '') || coalesce('WARC-Refers-To-Target-URI: ' || ou || e, '') || coalesce('WARC-Refers-To-Date: ' || oa || e, '') ELSE 'Content-Type: {HTTP}' || e END
  || 'Content-Length: ' || CASE WHEN v THEN 0 ELSE octet_length(encode(payload)) END || e || e AS header,
  CASE WHEN v THEN '' ELSE payload END AS payload
FROM t, (SELECT chr(13) || chr(10) AS e)
"""
