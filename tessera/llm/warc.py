"""WARC archives with a two-level capture index.

Every task writes one archive of records that are compressed one by one. The index sorts the
captures by their reversed-host URL keys: each index file holds compressed blocks of entries and,
at its end, a sparse directory with the first key of every block. A lookup binary-searches the
files' bounds, then the directory, and reads only the byte ranges of the blocks that may hold the
key; the entries in turn give the byte ranges of records.

File names are of one attempt of one task, and only tables written by Spark name them: what a
lost attempt leaves behind is never read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.decontaminate import sized
from tessera.llm.scratch import cut, new_path

#: Index entries in a compressed block.
BLOCK_ENTRIES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "key string, id bigint, archive string, at bigint, length bigint"
TAIL = "<QQ"


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then path and query: ``com,example)/path?x``."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:  # no URL: sorted by its text
        return f"){url}"
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + path


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One compressed record: a response with its payload, or a revisit without."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {json.dumps(url or '')[1:-1]}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head[3:3] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 1, mtime=0)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a compressed record; a revisit has none."""
    head, _, body = gzip.decompress(data).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, body[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def _writer(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        archive, at = f"{uuid.uuid4().hex}.warc.gz", 0
        out = None
        for batch in batches:
            rows = []
            for page, url, html, refers_to in zip(batch["id"].array, batch["url"].array, batch["html"].array, batch["refers_to"].array, strict=True):
                page, refers_to = (None if pd.isna(x) else int(x) for x in (page, refers_to))
                payload = bytes(html)
                data = record(page, url, payload, payload_digest(payload), refers_to)
                out = out or store.open_output_stream(f"{root}/{archive}", compression=None)
                out.write(data)
                rows.append((url_key(url), page, archive, at, len(data)))
                at += len(data)
            yield pd.DataFrame(rows, columns=["key", "id", "archive", "at", "length"]).astype({"id": "Int64"})
        if out:
            out.close()

    return write


def _indexer(folder: str):
    """Sorted entries to one index file: blocks, their directory, and where that begins."""

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        name, at, first, held, directory, out = f"{uuid.uuid4().hex}.idx", 0, None, [], [], None

        def flush():
            nonlocal at, held, out
            out = out or store.open_output_stream(f"{root}/{name}", compression=None)
            data = zlib.compress("\n".join(json.dumps(e) for e in held).encode(), 1)
            out.write(data)
            directory.append((held[0][0], at, len(data)))
            at, held = at + len(data), []

        for batch in batches:
            for row in zip(batch["key"], batch["id"].array, batch["archive"], batch["at"].tolist(), batch["length"].tolist(), strict=True):
                held.append((row[0], None if pd.isna(row[1]) else int(row[1]), *row[2:]))
                if len(held) == BLOCK_ENTRIES:
                    flush()
        if held:
            flush()
        if out:
            tail = zlib.compress(json.dumps(directory).encode(), 1)
            out.write(tail + struct.pack(TAIL, at, len(tail)))
            out.close()
            yield pd.DataFrame({"file": [name], "first": [directory[0][0]], "blocks": [len(directory)]})

    return index


class IndexFile:
    """One index file: its directory is read once, its blocks by byte range."""

    def __init__(self, folder: str, name: str):
        store, root = _store(folder)
        self.file = store.open_input_file(f"{root}/{name}")
        size = self.file.size()
        at, length = struct.unpack(TAIL, self.file.read_at(struct.calcsize(TAIL), size - struct.calcsize(TAIL)))
        self.directory = json.loads(zlib.decompress(self.file.read_at(length, at)))
        self.firsts = [d[0] for d in self.directory]

    def block(self, k: int) -> list[list]:
        _, at, length = self.directory[k]
        return [json.loads(line) for line in zlib.decompress(self.file.read_at(length, at)).split(b"\n")]

    def find(self, key: str) -> Iterator[list]:
        """Entries of a key: from the last block that begins before it, as far as blocks begin with it."""
        k = max(bisect.bisect_left(self.firsts, key) - 1, 0)
        while k < len(self.firsts) and self.firsts[k] <= key:
            yield from (e for e in self.block(k) if e[0] == key)
            k += 1


class Archives:
    """Written archives and their index."""

    def __init__(self, folder: str, files: DataFrame):
        self.folder, self.files = folder, files

    def entries(self) -> DataFrame:
        """All index entries, read block by block."""
        folder = self.folder

        def read(batches):
            for batch in batches:
                for name, blocks in zip(batch["file"], batch["blocks"], strict=True):
                    file = IndexFile(folder, name)
                    for k in range(blocks):
                        yield pd.DataFrame(file.block(k), columns=["key", "id", "archive", "at", "length"]).astype({"id": "Int64"})

        return self.files.select("file", "blocks").repartition(_tasks(self.files.sparkSession), "file").mapInPandas(read, ENTRY)

    def lookup(self, urls: DataFrame, url_col: str = "url") -> DataFrame:
        """``(key, id, archive, at, length)`` of all captures of the urls, one row for each.

        The driver holds one bound for each index file, not for each block.
        """
        folder, bounds = self.folder, sorted((r["first"], r["file"]) for r in self.files.collect())
        firsts = [b[0] for b in bounds]

        def route(batches):
            for batch in batches:
                rows = []
                for key in map(url_key, batch["url"]):
                    k = max(bisect.bisect_left(firsts, key) - 1, 0)
                    while k < len(bounds) and firsts[k] <= key:
                        rows.append((key, bounds[k][1]))
                        k += 1
                yield pd.DataFrame(rows, columns=["key", "file"])

        def find(batches):
            opened: dict[str, IndexFile] = {}
            for batch in batches:
                rows = []
                for key, name in zip(batch["key"], batch["file"], strict=True):
                    if name not in opened:
                        opened = {name: IndexFile(folder, name)}
                    rows += opened[name].find(key)
                yield pd.DataFrame(rows, columns=["key", "id", "archive", "at", "length"]).astype({"id": "Int64"})

        routed = urls.select(F.col(url_col).cast("string").alias("url")).distinct().mapInPandas(route, "key string, file string").distinct()
        return routed.repartition("file", "key").sortWithinPartitions("file", "key").mapInPandas(find, ENTRY)

    def records(self, entries: DataFrame) -> DataFrame:
        """``(id, url, type, refers_to, digest, payload)`` of the entries' records, by range reads; revisits have no payload."""
        folder = self.folder

        def read(batches):
            store, root = _store(folder)
            name, file = None, None
            for batch in batches:
                for part in (batch.iloc[k : k + 200] for k in range(0, len(batch), 200)):
                    rows = []
                    for archive, at, length in zip(part["archive"], part["at"].tolist(), part["length"].tolist(), strict=True):
                        if archive != name:
                            name, file = archive, store.open_input_file(f"{root}/{archive}")
                        fields, payload = parse(file.read_at(length, at))
                        kind = fields["WARC-Type"]
                        ids = [re.search(r"-?\d+", fields.get(f, "")) for f in ("WARC-Record-ID", "WARC-Refers-To")]
                        ids = [int(m[0]) if m else None for m in ids]
                        digest = fields["WARC-Payload-Digest"].partition(":")[2]
                        if kind == "response" and digest != payload_digest(payload):
                            raise ValueError(f"the payload at {at} of {archive} is not what was written")
                        rows.append((ids[0], json.loads(f'"{fields["WARC-Target-URI"]}"'), kind, ids[1], digest, payload if kind == "response" else None))
                    yield pd.DataFrame(rows, columns=["id", "url", "type", "refers_to", "digest", "payload"]).astype({"id": "Int64", "refers_to": "Int64"})

        ordered = entries.select("archive", "at", "length").repartition(_tasks(entries.sparkSession), "archive").sortWithinPartitions("archive", "at")
        return ordered.mapInPandas(read, "id bigint, url string, type string, refers_to bigint, digest string, payload binary")


def _tasks(spark) -> int:
    """How many tasks read or write archives: said, as an index is too small for Spark to tell what lies behind it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit: int = 0) -> Archives:
    """Archive a record per row of ``pages`` and index it by URL.

    Of rows with equal payloads (the html in UTF-8, empty for null) of at least ``least_revisit``
    bytes, the one with the largest id is a response and the others are revisits of it; rows that
    repeat that id and payload are responses too. Rows of a null id revisit if a row with an id has their payload and are responses otherwise. Null
    urls are empty. An empty table gives no archives. No other column is read.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("sha", F.sha1("html"))
    large = rows.where(F.octet_length("html") >= least_revisit)
    copies = cut(large.groupBy("sha").agg(F.max("id").alias("kept"), F.count("*").alias("n")).where("n > 1").select("sha", "kept"), "copies")
    known = rows.join(sized(copies, copies.count()), "sha", "left")
    refers_to = F.when(~F.col("id").eqNullSafe(F.col("kept")), F.col("kept"))
    entries = cut(known.select("id", "url", "html", refers_to.alias("refers_to")).mapInPandas(_writer(folder), ENTRY), "captures")
    files = entries.repartitionByRange(_tasks(spark), "key", "archive", "at").sortWithinPartitions("key", "archive", "at").mapInPandas(_indexer(folder), "file string, first string, blocks int")
    return Archives(folder, cut(files, "index"))


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit: int = 0) -> DataFrame:
    """``(id, payload_bytes, payload_digest, record_type, refers_to)`` of every archived row, as read back by the index.

    Sizes and digests are computed from the payloads read; those of revisits are taken from the
    response that they refer to. Cases as in :func:`write_archives`.
    """
    archives = write_archives(pages, id_col, url_col, html_col, least_revisit)
    read = archives.records(archives.entries()).select("id", "type", "refers_to", "digest", F.octet_length("payload").cast("bigint").alias("bytes"))
    read = cut(read, "read")
    full = read.where("type = 'response' and id is not null").groupBy(F.col("id").alias("refers_to"), "digest").agg(F.max("bytes").alias("full"))
    out = read.join(full, ["refers_to", "digest"], "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("bytes", "full").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
