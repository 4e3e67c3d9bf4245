"""WARC archives with a two-level capture index.

Each task writes archives of gzip members, one per record, to the shared folder, under a name of its
own attempt; only what an attempt that succeeded returned is in the table of captures, so a lost
executor leaves at most an orphan file. The index sorts captures by reversed-host URL key into
compressed blocks and keeps a sparse directory of the blocks' first keys; a lookup searches the
manifest of index files, then a file's directory, then one block, and reads the record's byte range.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

FILE_BYTES = 1 << 30
BLOCK_LINES = 512
LEVEL = 1
#: Archive bytes that one task reads back.
READ_BYTES = 16 << 20
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """``com,example)/path?query``: reversed host, lower-cased, then the rest; empty if there is no host."""
    m = re.match(r"[^:]*://([^/?#]*)([^#]*)", url or "", re.DOTALL)
    return re.sub(r"[\x00-\x1f]", " ", ",".join(reversed(m[1].lower().split("."))) + ")" + (m[2] or "/")) if m else ""


def _open(uri: str):
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def record(page_id: int | None, url: str | None, html: str | None, digest: str, head: int | None) -> bytes:
    """One WARC/1.1 record, a response or a revisit of head; URLs are percent-encoded where a header needs it."""
    name = lambda x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {x}')}>"
    payload = (html or "").encode("utf-8", "surrogatepass")
    uri = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "urn:none")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if head is None else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if head is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
    ]
    if head is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(head)}", f"X-Refers-To-Page: {head}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's headers and payload; the payload of a response must have its digest and length."""
    head, _, rest = data.partition(b"\r\n\r\n")
    h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(h["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    number = lambda x: int(x) if x else None
    out = {"page_id": number(h["X-Page-Id"]), "payload_bytes": int(h["X-Payload-Length"]), "payload_digest": h["WARC-Payload-Digest"][5:], "record_type": h["WARC-Type"], "refers_to": number(h.get("X-Refers-To-Page")), "payload": payload}
    if out["record_type"] == "response":
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != out["payload_digest"] or len(payload) != out["payload_bytes"]:
            raise ValueError(f"record of page {out['page_id']} is damaged")
    return out


def _write(folder: str, file_bytes: int):
    def run(batches):
        system, path = _open(f"{folder}/archives")
        system.create_dir(path, recursive=True)
        out, at, name = None, 0, ""
        for batch in batches:
            rows = []
            for page_id, url, html, sha, head in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None or at >= file_bytes:
                    if out:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = z.compress(record(page_id, url, html, base64.b32encode(bytes.fromhex(sha)).decode(), head)) + z.flush()
                out.write(data)
                rows.append((url_key(url), page_id, name, at, len(data)))
                at += len(data)
            if rows:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "page_id", "archive", "start", "length"])
        if out:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: str, least_revisit: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html); returns captures (key, page_id, archive, start, length).

    Of rows with equal payloads of least_revisit bytes or more, the one with the least page_id is the
    response (rows that repeat its page_id are responses too) and others are revisits of it. A null
    html is an empty payload; a null url has the key ''; a row without page_id is never referred to.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"))
    df = df.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    many = df.where(F.octet_length("html") >= least_revisit).groupBy("sha").agg(F.count("*").alias("n"), F.min("page_id").alias("head")).where("n > 1 and head is not null")
    many = shared.written(many, folder, "heads")
    if shared.is_small(many):
        df = df.join(F.broadcast(many.drop("n")), "sha", "left")
    else:  # payloads that repeat most (the empty one, say) don't meet in one task
        df = shared.join_counted(df, many, ["sha"], "n", many.agg(F.sum("n")).first()[0], "left")
    df = df.select("page_id", "url", "html", "sha", F.when(~F.col("head").eqNullSafe(F.col("page_id")), F.col("head")).alias("head"))
    return shared.written(df.mapInArrow(_write(folder, file_bytes), "key string, page_id long, archive string, start long, length long"), folder, "captures")


def _text(x) -> tuple[str, int]:
    """Sort key of (key, page_id) as Spark sorts it: UTF-8 bytes, then nulls first."""
    return x[0].encode("utf-8", "surrogatepass"), -(2**63) - 1 if x[1] is None else x[1]


def _index(folder: str, block_lines: int):
    def run(batches):
        system, path = _open(f"{folder}/index")
        system.create_dir(path, recursive=True)
        out, name, at, directory, lines, first, last = None, f"{uuid.uuid4().hex}", 0, [], [], None, None

        def flush():
            nonlocal at, lines
            data = zlib.compress("\n".join("\t".join("" if v is None else str(v) for v in x) for x in lines).encode("utf-8", "surrogatepass"), 6)
            out.write(data)
            directory.append(f"{lines[0][0]}\t{'' if lines[0][1] is None else lines[0][1]}\t{at}\t{len(data)}")
            at, lines = at + len(data), []

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None:
                    out, first = system.open_output_stream(f"{path}/{name}.blocks"), row[:2]
                lines.append((row[0].replace("\t", " ").replace("\n", " "), *row[1:]))
                last = row[:2]
                if len(lines) >= block_lines:
                    flush()
        if out is not None:
            if lines:
                flush()
            out.close()
            with system.open_output_stream(f"{path}/{name}.directory") as d:
                d.write("\n".join(directory).encode("utf-8", "surrogatepass"))
            yield pa.record_batch([pa.array([x], t) for x, t in zip((name, *first, *last), (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["file", "first_key", "first_page", "last_key", "last_page"])

    return run


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Writes the index of captures; returns its manifest, a row per index file (as many as tasks)."""
    ranged = captures.select("key", "page_id", "archive", "start", "length").repartitionByRange("key", "page_id", "archive", "start").sortWithinPartitions("key", "page_id")
    return shared.written(ranged.mapInArrow(_index(folder, block_lines), "file string, first_key string, first_page long, last_key string, last_page long"), folder, "manifest")


class _Lookup:
    """Reads index files and archives by range; keeps a few open, and one block."""

    def __init__(self, folder: str, manifest: list):
        self.folder, self.files, self.open_, self.directories, self.block = folder, sorted(manifest, key=lambda r: (_text(r[1:3]), _text(r[3:5]))), OrderedDict(), OrderedDict(), (None, [])
        self.lasts = [_text(r[3:5]) for r in self.files]

    def _file(self, name: str):
        if name not in self.open_:
            if len(self.open_) >= 64:
                self.open_.popitem(last=False)[1].close()
            system, path = _open(f"{self.folder}/{name}")
            self.open_[name] = system.open_input_file(path)
        self.open_.move_to_end(name)
        return self.open_[name]

    def _range(self, name: str, start: int, length: int) -> bytes:
        return self._file(name).read_at(length, start)

    def _rows(self, data: bytes) -> list:
        return [(k, int(p) if p else None, *rest) for k, p, *rest in (x.split("\t") for x in data.decode("utf-8", "surrogatepass").split("\n"))]

    def _directory(self, name: str) -> tuple[list, list]:
        if name not in self.directories:
            if len(self.directories) >= 8:
                self.directories.popitem(last=False)
            f = self._file(f"index/{name}.directory")
            rows = self._rows(f.read_at(f.size(), 0))
            self.directories[name] = rows, [_text(r[:2]) for r in rows]
        return self.directories[name]

    def find(self, key: str, page_id):
        """Captures of (key, page_id): (archive, start, length)."""
        want = _text((key, page_id))
        for i in range(bisect_left(self.lasts, want), len(self.files)):
            name, first = self.files[i][0], _text(self.files[i][1:3])
            if first > want:
                return
            rows, firsts = self._directory(name)
            for j in range(max(0, bisect_left(firsts, want) - 1), bisect_right(firsts, want)):
                if self.block[0] != (name, j):
                    lines = self._rows(zlib.decompress(self._range(f"index/{name}.blocks", int(rows[j][2]), int(rows[j][3]))))
                    self.block = (name, j), lines, [_text(x[:2]) for x in lines]
                _, lines, keys = self.block
                for k in range(bisect_left(keys, want), bisect_right(keys, want)):
                    yield lines[k][2], int(lines[k][3]), int(lines[k][4])

    def read(self, archive: str, start: int, length: int) -> dict:
        return parse(zlib.decompress(self._range(f"archives/{archive}", start, length), 31))


def _read(folder: str, manifest: list):
    def run(batches):
        look = _Lookup(folder, manifest)
        for batch in batches:
            out = [look.read(*found) for key, page_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for found in look.find(key, page_id)]
            if out:
                fields = [x.split() for x in RECORD.split(", ")]
                yield pa.record_batch([pa.array([r[n] for r in out], {"long": pa.int64(), "string": pa.string()}[t]) for n, t in fields], names=[n for n, _ in fields])

    return run


def lookup(captures_wanted: DataFrame, folder: str, manifest: DataFrame, read_bytes: int = READ_BYTES) -> DataFrame:
    """Records of the distinct (key, page_id) wanted, read through the index.

    Wanted captures that come with a length are dealt to one task per read_bytes of them, as every
    one costs a read of that length; keys alone are small and say nothing about it.
    """
    rows = [tuple(r) for r in manifest.collect()]  # a row per index file
    wanted = captures_wanted.select("key", "page_id").distinct()
    if "length" in captures_wanted.columns:
        total = captures_wanted.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        wanted = wanted.repartitionByRange(max(1, -(-total // read_bytes)), "key", "page_id")
    else:
        wanted = wanted.repartitionByRange("key", "page_id")
    return wanted.sortWithinPartitions("key", "page_id").mapInArrow(_read(folder, rows), RECORD)


def archive_and_read(pages: DataFrame, folder: str | None = None, least_revisit: int = 0, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Archives pages, indexes the captures, and reads every record back through the index.

    An empty table gives no rows. Columns besides page_id, url and html are ignored. Rows that repeat
    a page_id are records of their own: a capture is (key, page_id), and all records of it are read.
    """
    folder = folder or shared.work_folder(pages.sparkSession)
    captures = write_archives(pages, folder, least_revisit)
    return lookup(captures, folder, build_index(captures, folder, block_lines))
