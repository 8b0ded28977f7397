"""WARC archives of captured pages with a two-level index.

Writing: each task writes gzip members (one record each) to files of its own in a shared folder; a payload of at least
REVISIT_BYTES that another capture also has is stored once, under the largest id, and the others become revisit records.
Index: capture keys (reversed host, then path) are range-sorted and packed into compressed blocks of index lines; the
directory keeps the first key of each block. Blocks grow with the archive so that the directory never has more than
DIRECTORY_ENTRIES entries, which bounds what a reader holds. A lookup searches the directory by bisection, reads one
block by its byte range, bisects it and reads each record by its range.

A failed or repeated task leaves files that no manifest row names, so they are never read. Null payloads are empty,
null addresses have the empty key, a null id counts as the smallest. Repeated rows each have a record; of repeats of the
response's own id and payload, all are responses. Folders may be in any store that pyarrow.fs opens by URI.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import with_classes
from .storage import cut, partitions

REVISIT_BYTES = 1000
BLOCK_LINES = 3000
DIRECTORY_ENTRIES = 65_536
FILE_BYTES = 128 << 20
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def capture_key(url: str | None) -> str:
    """http://www.Example.org:80/a?b -> org,example,www)/a?b, with white space quoted, as the index sorts and stores it."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or ""), u.port
    except ValueError:
        return quote(url.strip().lower(), safe="/?&=,:;()")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return _clean(f"{key}){u.path or '/'}" + (f"?{u.query}" if u.query else ""))


def _clean(text: str) -> str:
    return re.sub(r"[\s\x00-\x1f]", lambda m: quote(m[0]), text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: tuple[int, str] | None) -> bytes:
    """One gzip member. refers: id and address of the response that a revisit stands for."""
    head = _HTTP.format(len(payload)).encode()
    name = f"<urn:page:{page_id if page_id is not None else 'null'}>"
    body = head if refers else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {name}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_clean(url or 'about:blank')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if refers:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers[0]}>", f"WARC-Refers-To-Target-URI: {_clean(refers[1] or 'about:blank')}"]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> dict:
    """Fields of one gzip member: page_id, type, refers_to, payload_bytes, payload_digest, url, payload (None: revisit)."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    told = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    ident = lambda x: None if x is None or "null" in x else int(x[10:-1])
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != told):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"page_id": ident(fields["WARC-Record-ID"]), "type": fields["WARC-Type"], "refers_to": ident(fields.get("WARC-Refers-To")), "payload_bytes": size, "payload_digest": told, "url": fields["WARC-Target-URI"], "payload": None if revisit else payload}


class Files:
    """Appends byte strings to new files of a folder, a new one from FILE_BYTES on."""

    def __init__(self, folder: str, ending: str):
        self.fs, self.path = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.ending, self.out, self.name, self.at = ending, None, "", 0

    def add(self, data: bytes) -> tuple[str, int]:
        if self.out is None or self.at >= FILE_BYTES:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}{self.ending}", 0
            self.out = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None)
        place = self.name, self.at
        self.out.write(data)
        self.at += len(data)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


class Ranges:
    """Range reads from the files of a folder; keeps a few of them open."""

    def __init__(self, folder: str):
        self.fs, self.path = pafs.FileSystem.from_uri(folder)
        self.open = lru_cache(64)(lambda name: self.fs.open_input_file(f"{self.path}/{name}"))

    def read(self, name: str, offset: int, length: int) -> bytes:
        f = self.open(name)
        f.seek(offset)
        return f.read(length)


def deduplicated(pages: DataFrame, page_id: str, url: str, payload: str) -> DataFrame:
    """page_id, url, payload, digest, refers_id, refers_url (null: a response). Only large payloads move to meet their copies."""
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    large = F.octet_length("payload") >= REVISIT_BYTES
    best = p.where(large).groupBy("digest").agg(F.max("page_id").alias("best_id"), F.max_by("url", "page_id").alias("best_url"), F.count("*").alias("times"))
    j = with_classes(p.where(large), best.where("times > 1 AND best_id IS NOT NULL"), "digest", "times", pages.count(), "left")
    again = F.col("best_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("best_id")))
    told = j.select("page_id", "url", "payload", "digest", F.when(again, F.col("best_id")).alias("refers_id"), F.when(again, F.coalesce("best_url", F.lit(""))).alias("refers_url"))
    none = F.lit(None)
    return told.unionByName(p.where(~large).withColumns({"refers_id": none.cast("long"), "refers_url": none.cast("string")}))


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write a record for every row; return the manifest (key, page_id, file, offset, length), a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(folder, ".warc.gz")
        for b in batches:
            rows = []
            for i, u, text, digest, rid, rurl in zip(*(c.to_pylist() for c in b.columns)):
                data = record(i, u, text.encode(), digest, None if rid is None else (rid, rurl))
                rows.append((capture_key(u), i, *files.add(data), len(data)))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["key", "page_id", "file", "offset", "length"])
        files.close()

    return cut(deduplicated(pages, page_id, url, payload).mapInArrow(run, "key string, page_id long, file string, offset long, length long"), "warc-manifest")


def build_index(manifest: DataFrame, folder: str) -> list[tuple[str, str, int, int]]:
    """Sort the manifest into compressed blocks; return the directory: (first key, file, offset, length) in the order of keys.

    Of blocks with one first key, the only one that may go on to other keys comes last.
    """
    rows = manifest.count()
    lines = max(BLOCK_LINES, -(-rows // (DIRECTORY_ENTRIES // 2)))
    # Each task ends with a block that isn't full, so tasks are bounded as well.
    tasks = max(1, min(partitions(manifest.sparkSession), -(-rows // lines), DIRECTORY_ENTRIES // 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(folder, ".cdx.z")
        block: list[str] = []
        firsts: list[tuple] = []

        def flush() -> None:
            data = zlib.compress("\n".join(block).encode(), 6)
            firsts.append((*(x.split("\t", 1)[0] for x in (block[0], block[-1])), *files.add(data), len(data)))
            block.clear()

        for b in batches:
            for key, i, name, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                block.append(f"{key}\t{'' if i is None else i}\t{name}\t{offset}\t{length}")
                if len(block) >= lines:
                    flush()
        if block:
            flush()
        files.close()
        cols = list(zip(*firsts)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["key", "last", "file", "offset", "length"])

    dealt = manifest.repartitionByRange(tasks, "key", "page_id", "offset").sortWithinPartitions("key", "page_id", "offset")
    made = sorted(tuple(r) for r in dealt.mapInArrow(run, "key string, last string, file string, offset long, length long").collect())
    return [(key, *place) for key, _, *place in made]


def verified(member: bytes) -> dict:
    """parse(), which checks the payload against its digest, without the payload."""
    return {**parse(member), "payload": None}


def block_lines(data: bytes) -> list[list[str]]:
    return [x.split("\t") for x in zlib.decompress(data).decode().split("\n")]


READ_SCHEMA = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, url string"


def read_archives(spark: SparkSession, directory: list[tuple], index_folder: str, folder: str) -> DataFrame:
    """Every record, by way of the index; payloads are read and checked against their digests."""
    kinds = "key string, file string, offset long, length long"
    places = spark.createDataFrame(directory, kinds) if directory else spark.createDataFrame([], kinds)
    tasks = max(1, min(len(directory), 4 * spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, archive = Ranges(index_folder), Ranges(folder)
        for b in batches:
            for name, offset, length in zip(*(c.to_pylist() for c in b.columns[1:])):
                found = [verified(archive.read(f, int(o), int(n))) for _, _, f, o, n in block_lines(index.read(name, offset, length))]
                yield _told(found)

    return places.repartition(tasks).mapInArrow(run, READ_SCHEMA)


def _told(found: list[dict]) -> pa.RecordBatch:
    cols = (("page_id", "page_id", pa.int64()), ("record_type", "type", pa.string()), ("refers_to", "refers_to", pa.int64()), ("payload_bytes", "payload_bytes", pa.int64()), ("payload_digest", "payload_digest", pa.string()), ("url", "url", pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for _, k, t in cols], [n for n, _, _ in cols])


class Index:
    """Blocks of the index by their place; keeps a few, so keys in order read each block once."""

    def __init__(self, folder: str):
        files = Ranges(folder)
        self.block = lru_cache(4)(lambda *place: block_lines(files.read(*place)))


def find(key: str, directory: list[tuple], index: Index) -> Iterable[tuple[str, int, int]]:
    """(file, offset, length) of every capture of a key: bisect the directory, then the blocks from there on."""
    at = max(0, bisect.bisect_left(directory, (key,)) - 1)
    while at < len(directory) and directory[at][0] <= key:
        lines = index.block(*directory[at][1:])
        i = bisect.bisect_left(lines, [key])
        while i < len(lines) and lines[i][0] == key:
            yield lines[i][2], int(lines[i][3]), int(lines[i][4])
            i += 1
        at += 1


def lookup(urls: DataFrame, url: str, directory: list[tuple], index_folder: str, folder: str) -> DataFrame:
    """The captures of each given address (READ_SCHEMA rows); the directory is bounded, so every task holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, archive = Index(index_folder), Ranges(folder)
        for b in batches:
            yield _told([verified(archive.read(*place)) for u in b.column(0).to_pylist() for place in find(capture_key(u), directory, index)])

    return urls.select(url).mapInArrow(run, READ_SCHEMA)


def read_captures(pages: DataFrame, directory: list[tuple], index_folder: str, folder: str, url: str = "url") -> DataFrame:
    """Every capture of the pages' addresses, each key looked up once by bisection; an address may have any number of captures."""
    place = "file string, offset long, length long"

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(u) for u in b.column(0).to_pylist()], pa.string())], ["key"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(index_folder)
        for b in batches:
            cols = list(zip(*(p for k in b.column(0).to_pylist() for p in find(k, directory, index)))) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()))], ["file", "offset", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = Ranges(folder)
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            for i in range(0, len(rows), 1000):
                yield _told([verified(archive.read(*p)) for p in rows[i : i + 1000]])

    asked = cut(pages.select(url).mapInArrow(keys, "key string").distinct(), "warc-keys")
    found = cut(asked.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(places, place), "warc-places")
    return found.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, READ_SCHEMA)
