"""WARC archives: a writer with revisit records, and a salvage reader.

Every record is written as a gzip member of its own; the reader takes members of many records too. It checks each member and record; after a failed check it searches
for the next member (or, in a plain archive, the next version line) that reads as a whole record, goes on from there,
and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import join_hot, scratch, slices, written

#: Payload bytes from which equal payloads are stored once; bytes after which a task starts its next archive.
REVISIT_BYTES, ARCHIVE_BYTES = 1000, 12 << 20
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_COLUMNS = "archive string, start long, stop long, kind string, record_type string, page_id long, uri string, payload_bytes long, payload_digest string, refers_to long, payload binary, reason string, inner_start long, inner_stop long"
_NAMES = [c.split()[0] for c in _COLUMNS.split(", ")]


def record(fields: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member; the same input gives the same bytes."""
    fields = {**fields, "WARC-Block-Digest": "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(), "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _urn(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr(parts))}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit of refers_to's response: the same HTTP head, without the payload."""
    digest = hashlib.sha1(payload).digest()
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": _urn(page_id, url), "WARC-Date": DATE}
    if url:
        fields["WARC-Target-URI"] = re.sub(r"\s", "%20", url)
    fields["WARC-Payload-Digest"] = "sha1:" + base64.b32encode(digest).decode()
    if page_id is not None:
        fields["X-Page-Id"] = str(page_id)
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "X-Refers-To-Page-Id": str(refers_to)}
    fields["Content-Type"] = "application/http;msgtype=response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record(fields, http if refers_to is not None else http + payload)


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """Write a record for each row of pages; the result lists the archives (path, n_records, n_bytes).

    Of the rows whose payloads (html in UTF-8, null: empty) are equal and have `least` bytes, those with the largest
    key are responses and the others revisit it; rows with a null key are responses where no row of their group has a key.
    """
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{url}`").cast("string").alias("u"), F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("t")).withColumn("d", F.sha1("t"))
    long = rows.where(F.octet_length("t") >= least).select("k", "d")
    last = long.groupBy("d").agg(F.max("k").alias("r"), F.count("*").alias("n")).where("n > 1")
    # Keys and digests alone meet by digest, those of many pages by a broadcast; the payloads are joined by key, so equal payloads stay spread.
    revisits = join_hot(long.distinct(), written(last, "digests"), "d", "n").drop("n").where("r IS NOT NULL AND NOT (k <=> r)")
    marked = rows.alias("p").join(revisits.alias("v"), F.expr("p.k <=> v.k AND p.d = v.d"), "left").select("p.k", "p.u", "p.t", "v.r").sortWithinPartitions("k", "u", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        place, part, held = TaskContext.get().partitionId(), 0, []

        def close() -> pa.RecordBatch:
            name, temporary = f"{base}/pages-{place:06d}-{part:05d}.warc.gz", f"{base}/.{uuid.uuid4().hex}.tmp"
            data = b"".join([record({"WARC-Type": "warcinfo", "WARC-Record-ID": _urn("info", place, part), "WARC-Date": DATE, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"), *held])
            with fs.open_output_stream(temporary) as f:
                f.write(data)
            fs.move(temporary, name)  # a repeated task replaces its own archive
            return pa.RecordBatch.from_pydict({"path": [name], "n_records": [len(held)], "n_bytes": [len(data)]})

        size = 0
        for b in slices(batches, 2, 4 << 20):
            for k, u, t, r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(page_record(k, u, t.encode(), r))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    part, size, held = part + 1, 0, []
        if held:
            yield close()

    return marked.mapInArrow(run, "path string, n_records long, n_bytes long")


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int] | str:
    """Fields, block and end of the whole record that begins at a place, or what is wrong with it."""
    if not (m := _VERSION.match(data, at)):
        return "no version line"
    end = data.find(b"\r\n\r\n", m.end() - 2)
    if end < 0:
        return "no end of header"
    fields = {}
    for line in data[m.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon and line:
            return "bad header line"
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    if not size.isascii() or not size.isdigit():
        return "no content length"
    start = end + 4
    block = data[start : start + int(size)]
    if len(block) < int(size):
        return "truncated block"
    digest = fields.get("warc-block-digest", "")
    if digest.startswith("sha1:") and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest[5:].upper():
        return "block digest differs"
    return fields, block, start + int(size)


def _member(data: bytes, at: int, piece: int = 16 << 10) -> tuple[bytes, int, str]:
    """The content and the end of the gzip member at a place, or what could be read of a damaged one, its place and what is wrong; it is read by pieces, so the rest of the archive isn't touched."""
    unpacker, out, begin = zlib.decompressobj(31), [], at
    view = memoryview(data)
    try:
        while not unpacker.eof:
            if at >= len(data):
                return b"".join(out), begin, "truncated gzip member"
            out.append(unpacker.decompress(view[at : at + piece]))
            at += piece
    except zlib.error as e:
        return b"".join(out), begin, f"bad gzip member: {e}"[:80]
    return b"".join(out), min(at, len(data)) - len(unpacker.unused_data), ""


def _inside(content: bytes, damaged: bool) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str]]:
    """Like salvage, of a member's content. Of a damaged member only records with a block digest count."""
    gap, reason, at = None, "", 0
    while at < len(content):
        found = parse(content, at)
        if damaged and isinstance(found, tuple) and not found[0].get("warc-block-digest", "").startswith("sha1:"):
            found = "no block digest in a damaged member"
        if isinstance(found, tuple):
            if gap is not None:
                yield gap, at, None, b"", reason
                gap = None
            stop = found[2]
            while content.startswith(b"\r\n", stop):
                stop += 2
            yield at, stop, found[0], found[1], ""
            at = stop
            continue
        if gap is None:
            gap, reason = at, found
        m = _VERSION.search(content, at + 1)
        at = m.start() if m else len(content)
    if gap is not None:
        yield gap, len(content), None, b"", reason


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str, int | None, int | None]]:
    """(start, stop, fields, block, reason, inner start, inner stop) of each record, or with fields None of each quarantined gap, in the order of the bytes.

    Inner places count bytes of the content of the gzip member from start to stop; they are null unless the member holds more than one record or
    gap. Records that could be read of a damaged member have its start as stop, too: its bytes are a gap of their own.
    """
    gap, reason, at = None, "", 0
    version = -1  # the next version line, looked for once
    while at < len(data):
        rows = []
        if data.startswith(b"\x1f\x8b", at):
            content, stop, found = _member(data, at)
            inside = [*_inside(content, bool(found))]
            if any(r[2] is not None for r in inside):
                sole = len(inside) == 1 and not found
                rows = [(at, stop, *r[2:], *((None, None) if sole else r[:2])) for r in inside if not found or r[2] is not None]
            found = found or (inside[0][4] if inside else "no version line")
        else:
            found = parse(data, at)
            stop = found[2] if isinstance(found, tuple) else at
            while isinstance(found, tuple) and data.startswith(b"\r\n", stop):
                stop += 2
            if isinstance(found, tuple):
                rows = [(at, stop, found[0], found[1], "", None, None)]
        if rows:
            if gap is not None:
                yield gap, at, None, b"", reason, None, None
                gap = None
            yield from rows
        if rows and stop > at:
            at = stop
            continue
        if gap is None:
            gap, reason = at, found
        if stop > at:  # a whole member without a record
            at = stop
            continue
        if version <= at:
            m = _VERSION.search(data, at + 1)
            version = m.start() if m else len(data)
        member = data.find(b"\x1f\x8b\x08", at + 1, version)
        at = member if member >= 0 else version
    if gap is not None:
        yield gap, len(data), None, b"", reason, None, None


def read_archives(spark: SparkSession, path: str, glob: str = "*.warc*", payloads: bool = True) -> DataFrame:
    """Rows of all records and gaps of the archives under a path: archive, start, stop (bytes), kind ('record' or 'gap'), record_type, page_id,
    uri, payload_bytes, payload_digest (lower-case hex SHA-1), refers_to, payload, reason (of a gap), inner_start, inner_stop (see salvage).

    Size and digest are those of the whole payload: computed for records that hold it, stated for revisits. A record
    whose payload differs from its stated digest is a gap. Folders without an archive give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, size = [], 0
                for start, stop, fields, block, reason, *inner in salvage(content.as_py()):
                    rows.append((*_row(name, start, stop, fields, block, reason, payloads), *inner))
                    size += len(block)
                    if size > 4 << 20 or len(rows) >= 2000:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return raw.select("path", "content").mapInArrow(run, _COLUMNS)


def _row(name: str, start: int, stop: int, fields: dict[str, str] | None, block: bytes, reason: str, payloads: bool) -> tuple:
    if fields is None:
        return (name, start, stop, "gap", None, None, None, None, None, None, None, reason)
    kind, page, refers = fields.get("warc-type"), fields.get("x-page-id"), fields.get("x-refers-to-page-id")
    payload, stated, size = block, fields.get("warc-payload-digest", "").removeprefix("sha1:"), len(block)
    if fields.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        length = re.search(rb"(?i)\ncontent-length: *(\d+)", head)
        size = int(length[1]) if length and kind == "revisit" else len(payload)
    digest = _hex(stated) if kind == "revisit" and stated else hashlib.sha1(payload).hexdigest()
    if stated and _hex(stated) != digest or digest is None:
        return (name, start, stop, "gap", None, None, None, None, None, None, None, "payload digest differs")
    return (name, start, stop, "record", kind, _int(page), fields.get("warc-target-uri"), size, digest, _int(refers), payload if payloads else None, None)


def _hex(digest: str) -> str | None:
    try:
        return base64.b32decode(digest).hex()
    except ValueError:
        return None


def _int(text: str | None) -> int | None:
    """A whole number of 64 bits."""
    if not text or not re.fullmatch(r"-?[0-9]{1,19}", text):
        return None
    return int(text) if -(1 << 63) <= int(text) < 1 << 63 else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[s.split()[1]]) for c, s in zip(zip(*rows, strict=True), _COLUMNS.split(", "), strict=True)], names=_NAMES)


def archives(pages: DataFrame, folder: str | None = None, **options) -> str:
    """Write the archives and return their folder."""
    folder = folder or scratch(pages.sparkSession, "warc")
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    write_archives(pages, folder, **options).agg(F.sum("n_records")).collect()
    return folder
