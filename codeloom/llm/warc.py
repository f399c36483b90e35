"""Web captures: WARC files, and a two-level index for looking them up.

``write_warc`` stores every page as one WARC response record, a gzip member of its own, after a warcinfo record. The index sorts
the captures by URL key (host labels reversed, then path and query) into shards,
one file each. A shard is a run of blocks, about BLOCK captures compressed together,
then its directory: the first key, offset and length of every block. The
sparse directory is found by the last 8 bytes of the file. Above it there is only the
first key of each shard. ``lookup`` binary-searches the shards, then the shard's
directory, reads the one range of bytes that holds the block, and
binary-searches that. Queries are sorted like the index, so a task reads every
block it needs once, in order. Files are named by task attempt and only those of
finished tasks are referred to, so a lost executor or a repeated task does no harm.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Table, new_path

BLOCK, FILE_BYTES = 512, 256 << 20
_RECORD = "page_id long, url_key string, url string, file string, offset long, length long"
_SHARD = "first_key string, first_id long, file string, captures long, blocks long"
_PLACE = "page_id long, url_key string, file string, offset long, length long"
_READ = "page_id long, url_key string, html string"


def url_key(url: Column) -> Column:
    """com,example,blog)/path?query of a URL: no scheme, user, port, leading www. or fragment; the host in lower case, the rest as it is."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.lower(F.regexp_extract(bare, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), "^www[.]", "")
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    rest = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), F.lit(")"), rest)


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _member(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in (fields | {"Content-Length": len(block)}).items())
    return gzip.compress(b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n", compresslevel=1, mtime=0)


def _identity(file: str, offset: int) -> str:
    """A record's id; files have names of their own, so no two records share one."""
    return f"<urn:uuid:{uuid.UUID(bytes=xxhash.xxh3_128_digest(f'{file}:{offset}'), version=4)}>"


def info_record(file: str, date: str) -> bytes:
    """The warcinfo record that opens a file."""
    fields = {"WARC-Type": "warcinfo", "WARC-Record-ID": _identity(file, 0), "WARC-Date": date, "WARC-Filename": file, "Content-Type": "application/warc-fields"}
    return _member(fields, b"software: codeloom\r\nformat: WARC File Format 1.1\r\n")


def record(url: str, file: str, offset: int, date: str, payload: bytes) -> bytes:
    """One WARC/1.1 response record, with the HTTP head it needs, as a gzip member."""
    digest = base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()
    fields = {"WARC-Type": "response", "WARC-Record-ID": _identity(file, offset), "WARC-Date": date, "WARC-Target-URI": "".join(url.split()) or "about:blank", "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
    return _member(fields, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a response record's gzip member."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def write_warc(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the rows that have a page_id and a url; gives where each record lies. A null html is an empty payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _filesystem(folder)
        system.create_dir(path, recursive=True)
        out, name, at, date = None, "", 0, datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        try:
            for batch in batches:
                rows = []
                for page, key, url, text in zip(*(batch.column(c) for c in ("page_id", "url_key", "url", "h")), strict=True):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{path}/{name}", compression=None)
                        head = info_record(name, date)
                        out.write(head)
                        at = len(head)
                    member = record(url.as_py(), name, at, date, (text.as_py() or "").encode("utf-8", "surrogatepass"))
                    out.write(member)
                    rows.append((page.as_py(), key.as_py(), url.as_py(), name, at, len(member)))
                    at += len(member)
                if rows:
                    yield _batch(rows, _RECORD)
        finally:
            if out is not None:
                out.close()

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), url_key(F.col("url")).alias("url_key"), "url", F.col("html").alias("h"))
    return narrow.where("page_id is not null and url is not null").mapInArrow(run, _RECORD)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    types = {"long": pa.int64(), "string": pa.string()}
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def build_index(records: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """One row a shard of the index over the records: its first capture, file, and numbers of captures and blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _filesystem(folder)
        system.create_dir(path, recursive=True)
        press, directory, held, at, total, out = zstandard.ZstdCompressor(level=3), [], [], 0, 0, None
        name = f"{uuid.uuid4().hex}.idx"

        def put(own: list[tuple]) -> None:
            nonlocal at, total
            data = press.compress(json.dumps(own, separators=(",", ":")).encode())
            directory.append((own[0][0], own[0][1], at, len(data)))
            out.write(data)
            at, total = at + len(data), total + len(own)

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("url_key", "page_id", "file", "offset", "length")), strict=True)
            while len(held) > block:
                out = out or system.open_output_stream(f"{path}/{name}", compression=None)
                put(held[:block])
                held = held[block:]
        if held:
            out = out or system.open_output_stream(f"{path}/{name}", compression=None)
            put(held)
            tail = press.compress(json.dumps(directory, separators=(",", ":")).encode())
            out.write(tail)
            out.write(len(tail).to_bytes(8, "little"))
            out.close()
            yield _batch([(directory[0][0], directory[0][1], name, total, len(directory))], _SHARD)

    ordered = records.select("url_key", "page_id", "file", "offset", "length").repartitionByRange("url_key", "page_id").sortWithinPartitions("url_key", "page_id", "file", "offset")
    return ordered.mapInArrow(run, _SHARD)


class Shard:
    """One index file: its directory, and the block read last."""

    def __init__(self, system: pafs.FileSystem, path: str) -> None:
        self.file = system.open_input_file(path)
        size = self.file.size()
        length = int.from_bytes(self.file.read_at(8, size - 8), "little")
        self.open = zstandard.ZstdDecompressor()
        self.directory = [tuple(x) for x in json.loads(self.open.decompress(self.file.read_at(length, size - 8 - length)))]
        self.keys = [(x[0], x[1]) for x in self.directory]
        self.at, self.block = -1, []
        self.reads = 0

    def entries(self, k: int) -> list[tuple]:
        if k != self.at:
            _, _, offset, length = self.directory[k]
            self.block = [tuple(x) for x in json.loads(self.open.decompress(self.file.read_at(length, offset)))]
            self.at = k
            self.reads += 1
        return self.block

    def find(self, key: str, page: int) -> Iterator[tuple]:
        """All captures with this key and id."""
        k = max(0, bisect.bisect_left(self.keys, (key, page)) - 1)
        while k < len(self.keys) and self.keys[k] <= (key, page):
            own = self.entries(k)
            i = bisect.bisect_left(own, (key, page), key=lambda x: (x[0], x[1]))
            while i < len(own) and own[i][:2] == (key, page):
                yield own[i]
                i += 1
            k += 1


def lookup(queries: DataFrame, shards: list[tuple[str, int, str]], folder: str) -> DataFrame:
    """All captures of each (url_key, page_id) of queries: ``(page_id, url_key, file, offset, length)``; a query without a capture gives no row.

    shards: (first key, first id, file) in order. Equal keys and ids are always in one shard.
    """
    firsts = [(key, page) for key, page, _ in shards]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _filesystem(folder)
        at, shard = -1, None
        for batch in batches:
            rows = []
            for key, page in zip(batch.column("url_key").to_pylist(), batch.column("page_id").to_pylist(), strict=True):
                k = bisect.bisect_right(firsts, (key, page)) - 1
                if k < 0:
                    continue
                if k != at:
                    at, shard = k, Shard(system, f"{path}/{shards[k][2]}")
                rows += [(page, key, *x[2:]) for x in shard.find(key, page)]
            yield _batch(rows, _PLACE)

    return queries.mapInArrow(run, _PLACE)


def read_records(located: DataFrame, folder: str) -> DataFrame:
    """``(page_id, url_key, html)`` of located records, each read as one range of its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _filesystem(folder)
        name, file = None, None
        for batch in batches:
            rows, held = [], 0
            for page, key, own, offset, length in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url_key", "file", "offset", "length")), strict=True):
                if own != name:
                    name, file = own, system.open_input_file(f"{path}/{own}")
                payload = parse_record(file.read_at(length, offset))[1]
                rows.append((page, key, payload.decode("utf-8", "surrogatepass")))
                held += len(payload)
                if held > 8 << 20:
                    yield _batch(rows, _READ)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, _READ)

    return located.repartition("file").sortWithinPartitions("file", "offset").mapInArrow(run, _READ)


def captured(pages: DataFrame) -> DataFrame:
    """``(page_id, url_key, captures, html_bytes, html_md5)``: every page looked up by its URL in an index of all pages and read back.

    captures is the number of rows with the same URL key; html_bytes and html_md5 are of what is read from the
    WARC file. A null html is read back as empty. Rows without a page_id or a url aren't captured and give no row; rows that
    share both give one row each. Only page_id, url and html are read.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "captures")
    records = Table(write_warc(pages, folder), "capture-records")
    shards = sorted((r.first_key, r.first_id, r.file) for r in build_index(records.df, folder).collect())
    asked = records.df.select("url_key", "page_id").distinct().repartitionByRange("url_key", "page_id").sortWithinPartitions("url_key", "page_id")
    located = Table(lookup(asked, shards, folder), "located")
    records.drop()
    counts = located.df.groupBy("url_key").agg(F.count(F.lit(1)).alias("captures"))
    read = read_records(located.df, folder).select("page_id", "url_key", F.octet_length("html").cast("long").alias("html_bytes"), F.md5("html").alias("html_md5"))
    return read.join(counts, "url_key").select("page_id", "url_key", "captures", "html_bytes", "html_md5")


ORACLE = r"""
WITH bare AS (
  SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS u
  FROM pages WHERE page_id IS NOT NULL AND url IS NOT NULL
), parts AS (
  SELECT page_id, html, regexp_replace(u, '^[^/?]*', '') AS rest,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '^www[.]', '') AS host
  FROM bare
), keyed AS (
  SELECT page_id, coalesce(html, '') AS html,
    array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END AS url_key
  FROM parts
)
SELECT page_id, url_key, count(*) OVER (PARTITION BY url_key) AS captures, CAST(strlen(html) AS BIGINT) AS html_bytes, md5(html) AS html_md5
FROM keyed
"""
