"""Metadata of image files: TIFF directories (EXIF and GPS) and XMP packets in JPEG, TIFF and PNG files, read from their first bytes.

Spark lists and deals out the files; a small parser sees the head of one file. It reads no pixels, and a broken file becomes a row that says so.
"""

from __future__ import annotations

import html
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .readers import images

#: Bytes of a file that are looked at; metadata stands before the pixels.
HEAD = 256 << 10
#: Bytes and form of the values of TIFF fields by their type.
TYPES = {1: (1, "B"), 2: (1, None), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 7: (1, None), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d")}
#: Tags that lead to directories and packets, and names of the tags of each directory.
EXIF_DIRECTORY, GPS_DIRECTORY, PACKET = 34665, 34853, 700
TAGS = {
    "image": {256: "ImageWidth", 257: "ImageHeight", 271: "Make", 272: "Model", 274: "Orientation", 306: "ModifyDate"},
    "exif": {33434: "ExposureTime", 33437: "FNumber", 34855: "ISO", 36867: "DateTimeOriginal", 37386: "FocalLength", 40962: "ExifImageWidth", 40963: "ExifImageHeight", 41989: "FocalLengthIn35mmFormat"},
    "gps": {1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude"},
}
EXIF_MARK, XMP_MARK, PNG_MARK = b"Exif\0\0", b"http://ns.adobe.com/xap/1.0/\0", b"\x89PNG\r\n\x1a\n"
#: Values of an XMP packet: attributes, and elements without elements in them.
ATTRIBUTE = re.compile(rb"([A-Za-z_][\w.-]*):([A-Za-z_][\w.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
ELEMENT = re.compile(rb"<([A-Za-z_][\w.-]*):([A-Za-z_][\w.-]*)(?:\s[^<>]*)?>([^<>]*)</\1:\2\s*>")
FIELDS = "width int, height int, exif map<string, string>, xmp map<string, string>, problem string"


def directory(data: bytes, order: str, at: int, names: dict[int, str]) -> tuple[dict, dict]:
    """Values by name of the TIFF directory at a place, and of the tags that lead elsewhere by number; fields beyond the data are passed over."""
    found, links = {}, {}
    (count,) = struct.unpack_from(order + "H", data, at)
    for i in range(count):
        if at + 14 + 12 * i > len(data):
            break
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in TYPES or (tag not in names and tag not in (EXIF_DIRECTORY, GPS_DIRECTORY, PACKET)):
            continue
        size, form = TYPES[kind]
        place = at + 10 + 12 * i
        if size * n > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        if place + size * n > len(data):
            continue
        if tag == PACKET:
            links[tag] = data[place : place + size * n]
            continue
        if form is None:
            value = data[place : place + n].split(b"\0")[0].decode("utf-8", "replace").strip()
        else:
            parts = struct.unpack_from(order + form * n, data, place)
            if len(form) == 2:
                parts = tuple(a / b if b else float("nan") for a, b in zip(parts[::2], parts[1::2], strict=True))
            value = parts[0] if len(parts) == 1 else parts
        if tag in names:
            found[names[tag]] = value
        else:
            links[tag] = value
    return found, links


def _degrees(value, reference) -> float | None:
    """Degrees of (degrees, minutes, seconds), negative in the south and west."""
    parts = value if isinstance(value, tuple) else (value,)
    if not all(isinstance(p, int | float) for p in parts):
        return None
    total = sum(p / 60**i for i, p in enumerate(parts[:3]))
    return -total if str(reference).upper() in ("S", "W") else total


def tiff(data: bytes) -> tuple[dict, bytes]:
    """EXIF and GPS values of a TIFF block by name, and its XMP packet. GPSLatitude and GPSLongitude are in signed degrees."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("no TIFF header")
    found, links = directory(data, order, struct.unpack_from(order + "I", data, 4)[0], TAGS["image"])
    if EXIF_DIRECTORY in links:
        found |= directory(data, order, links[EXIF_DIRECTORY], TAGS["exif"])[0]
    if GPS_DIRECTORY in links:
        gps = directory(data, order, links[GPS_DIRECTORY], TAGS["gps"])[0]
        for name in ("GPSLatitude", "GPSLongitude"):
            if name in gps:
                found[name] = _degrees(gps[name], gps.get(f"{name}Ref"))
        if isinstance(gps.get("GPSAltitude"), int | float):
            found["GPSAltitude"] = -gps["GPSAltitude"] if gps.get("GPSAltitudeRef") == 1 else gps["GPSAltitude"]
    return found, links.get(PACKET, b"")


def xmp(packet: bytes) -> dict[str, str]:
    """Values of an XMP packet by their names without prefix, in the packet's order; a name's first value counts."""
    hits = [(m.start(), m[2], m[3] if m[3] is not None else m[4]) for m in ATTRIBUTE.finditer(packet) if m[1] != b"xmlns"]
    hits += [(m.start(), m[2], m[3]) for m in ELEMENT.finditer(packet)]
    found: dict[str, str] = {}
    for _, name, value in sorted(hits):
        found.setdefault(name.decode(), html.unescape(value.decode("utf-8", "replace")).strip())
    return found


def _jpeg(data: bytes) -> tuple:
    """Size, TIFF block and packet from a JPEG's segments before its pixels."""
    at, size, block, packet = 2, (None, None), b"", b""
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xD9, 0xDA):
        if data[at + 1] == 0xFF:  # fill byte
            at += 1
            continue
        (n,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + n]
        if data[at + 1] == 0xE1 and body.startswith(EXIF_MARK) and not block:
            block = body[len(EXIF_MARK) :]
        elif data[at + 1] == 0xE1 and body.startswith(XMP_MARK):
            packet = packet or body[len(XMP_MARK) :]
        elif 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC) and len(body) >= 5:
            size = struct.unpack_from(">HH", body, 1)[::-1]
        at += 2 + n
    return *size, block, packet


def _png(data: bytes) -> tuple:
    at, size, block, packet = len(PNG_MARK), (None, None), b"", b""
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR" and len(body) >= 8:
            size = struct.unpack_from(">II", body)
        elif kind == b"eXIf":
            block = body
        elif kind == b"iTXt" and body.startswith(b"XML:com.adobe.xmp\0\0"):
            packet = body.split(b"\0", 5)[5]
        elif kind == b"IDAT":
            break
        at += 12 + n
    return *size, block, packet


def parse(data: bytes) -> tuple[int | None, int | None, dict[str, str], dict[str, str], str | None]:
    """Width, height, EXIF values, XMP values and what is wrong with a file's head. What was read before an error stays."""
    width = height = problem = None
    exif: dict = {}
    packet = b""
    try:
        if data.startswith(b"\xff\xd8"):
            width, height, block, packet = _jpeg(data)
        elif data.startswith(PNG_MARK):
            width, height, block, packet = _png(data)
        elif data[:2] in (b"II", b"MM"):
            block = data
        else:
            return None, None, {}, {}, "no JPEG, PNG or TIFF file"
        if block:
            exif, own = tiff(block)
            packet = packet or own
            if block is data:
                width, height = exif.get("ImageWidth"), exif.get("ImageHeight")
    except (struct.error, ValueError, IndexError) as e:
        problem = f"broken metadata: {e}"
    text = {k: v if isinstance(v, str) else repr(v) for k, v in exif.items() if v is not None and not isinstance(v, tuple)}
    fit = lambda v: v if isinstance(v, int) and 0 < v < 1 << 31 else None
    return fit(width), fit(height), text, xmp(packet), problem


def with_metadata(files: DataFrame, content: str = "content") -> DataFrame:
    """files without their content, and with width, height, exif, xmp and problem of it; null content is a problem too."""
    rest = [c for c in files.columns if c != content]
    picked = files.select(*(F.col(f"`{c}`") for c in rest), F.expr(f"substring(`{content}`, 1, {HEAD})").alias("_head"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), pa.string()), pa.string()
        for b in batches:
            found = [parse(x.as_py()) if x.is_valid else (None, None, {}, {}, "no content") for x in b.column(b.num_columns - 1)]
            columns = list(zip(*found, strict=True)) if found else [()] * 5
            arrays = [pa.array([list(v.items()) for v in c] if pa.types.is_map(k) else list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *arrays], names=[*rest, "width", "height", "exif", "xmp", "problem"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]), FIELDS])
    return picked.mapInArrow(run, schema)


def image_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, length, modificationTime, width, height, exif, xmp, problem) of the image files under a folder."""
    return with_metadata(images(spark, path))
