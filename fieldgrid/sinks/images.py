"""Files that carry image metadata: JPEG heads with EXIF, GPS and XMP, without pixels, as exchange with tools that read metadata only."""

from __future__ import annotations

import html
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame

from ..sources.images import EXIF_DIRECTORY, EXIF_MARK, GPS_DIRECTORY, XMP_MARK

#: Fixed value: the drone maker's names in XMP.
NAMESPACE = "http://www.dji.com/drone-dji/1.0/"


def _fields(entries: list[tuple[int, int, int, bytes]], at: int) -> bytes:
    """A TIFF directory at a place, from tags, types, counts and values, with the longer values behind it."""
    out, tail = struct.pack("<H", len(entries)), b""
    behind = at + 2 + 12 * len(entries) + 4
    for tag, kind, n, value in sorted(entries):
        if len(value) > 4:
            out += struct.pack("<HHII", tag, kind, n, behind + len(tail))
            tail += value + b"\0" * (len(value) % 2)
        else:
            out += struct.pack("<HHI", tag, kind, n) + value.ljust(4, b"\0")
    return out + b"\0\0\0\0" + tail


def _rational(*values: float, parts: int = 1_000_000) -> bytes:
    return b"".join(struct.pack("<II", round(v * parts), parts) for v in values)


def exif_block(width: int, height: int, lat: float | None, lon: float | None, altitude: float | None) -> bytes:
    gps: list[tuple[int, int, int, bytes]] = []
    for tag, value, signs in ((1, lat, b"NS"), (3, lon, b"EW")):
        if value is not None:
            whole, minutes = divmod(abs(value) * 60, 60)
            low, seconds = divmod(minutes * 60, 60)
            gps += [(tag, 2, 2, signs[value < 0 :][:1] + b"\0"), (tag + 1, 5, 3, _rational(whole, low, seconds))]
    if altitude is not None:
        gps += [(5, 1, 1, bytes([altitude < 0])), (6, 5, 1, _rational(abs(altitude), parts=1000))]
    first = _fields([(EXIF_DIRECTORY, 4, 1, b""), (GPS_DIRECTORY, 4, 1, b"")], 8)
    exif = _fields([(40962, 4, 1, struct.pack("<I", width)), (40963, 4, 1, struct.pack("<I", height))], 8 + len(first))
    places = struct.pack("<I", 8 + len(first)), struct.pack("<I", 8 + len(first) + len(exif))
    first = _fields([(EXIF_DIRECTORY, 4, 1, places[0]), (GPS_DIRECTORY, 4, 1, places[1])], 8)
    return b"II*\0" + struct.pack("<I", 8) + first + exif + _fields(gps, 8 + len(first) + len(exif))


def xmp_packet(values: dict[str, str]) -> bytes:
    inner = " ".join(f'drone-dji:{k}="{html.escape(v)}"' for k, v in values.items())
    return f'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:drone-dji="{NAMESPACE}" {inner}/></rdf:RDF></x:xmpmeta>'.encode()


def jpeg_head(width: int, height: int, lat: float | None, lon: float | None, altitude: float | None, xmp: dict[str, str]) -> bytes:
    """A JPEG's segments up to its frame header: EXIF with GPS, XMP, size."""
    segment = lambda mark, body: bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body
    exif, packet = EXIF_MARK + exif_block(width, height, lat, lon, altitude), XMP_MARK + xmp_packet(xmp)
    frame = struct.pack(">BHHB", 8, height, width, 1) + b"\x01\x11\0"
    return b"\xff\xd8" + segment(0xE1, exif) + (segment(0xE1, packet) if xmp else b"") + segment(0xC0, frame) + b"\xff\xd9"


def image_heads(df: DataFrame) -> DataFrame:
    """Rows (name, value): the file <name>.jpg, as bytes, of each row (name, width, height, lat, lon, altitude, xmp map<string, string>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            made = [jpeg_head(*values, dict(xmp or ())) for _, *values, xmp in rows]
            yield pa.RecordBatch.from_arrays([pa.array([f"{r[0]}.jpg" for r in rows], pa.string()), pa.array(made, pa.binary())], names=["name", "value"])

    return df.select("name", "width", "height", "lat", "lon", "altitude", "xmp").mapInArrow(run, "name string, value binary")


def write_image_heads(df: DataFrame, folder: str) -> DataFrame:
    """Write a file <name>.jpg for each row (name, width, height, lat, lon, altitude, xmp map<string, string>); the result lists rows (path, length).

    Tasks write the files of their rows as the result is read; a repeated task writes the same bytes to the same names, and of rows with one
    name the last written stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for b in batches:
            paths, sizes = [], []
            for name, width, height, lat, lon, altitude, xmp in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = jpeg_head(width, height, lat, lon, altitude, dict(xmp or ()))
                with fs.open_output_stream(f"{base}/{name}.jpg") as f:
                    f.write(data)
                paths.append(f"{folder}/{name}.jpg")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "length"])

    return df.select("name", "width", "height", "lat", "lon", "altitude", "xmp").mapInArrow(run, "path string, length long")
