"""Shapefiles, zipped or bare: records of points, lines and polygons with their attributes. Spark lists and deals out the files; a parser sees one."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Kinds of shapes by their codes; those with heights and measures hold their plain form first.
KINDS = {0: "null", 1: "point", 3: "line", 5: "polygon", 8: "points", 11: "point", 13: "line", 15: "polygon", 18: "points", 21: "point", 23: "line", 25: "polygon", 28: "points"}
SHAPE = "layer string, n int, kind string, parts array<array<struct<x: double, y: double>>>, attributes map<string, string>, problem string"


def shape(body: bytes) -> tuple[str, list[list[dict]]]:
    """Kind and parts of a record's content."""
    (code,) = struct.unpack_from("<i", body)
    kind = KINDS.get(code)
    if kind is None:
        raise ValueError(f"shape of code {code}")
    pairs = lambda at, n: [{"x": x, "y": y} for x, y in np.frombuffer(body, "<f8", 2 * n, at).reshape(-1, 2).tolist()]
    if kind == "null":
        return kind, []
    if kind == "point":
        return kind, [pairs(4, 1)]
    if kind == "points":
        return kind, [pairs(40, struct.unpack_from("<i", body, 36)[0])]
    n_parts, n = struct.unpack_from("<ii", body, 36)
    starts = [*struct.unpack_from(f"<{n_parts}i", body, 44), n]
    points = pairs(44 + 4 * n_parts, n)
    return kind, [points[i:j] for i, j in zip(starts, starts[1:], strict=False)]


def records(shp: bytes) -> Iterator[bytes]:
    """Contents of the records of a .shp file; a cut record ends them."""
    if len(shp) < 100 or struct.unpack_from(">i", shp)[0] != 9994:
        raise ValueError("no shapefile header")
    at = 100
    while at + 8 <= len(shp):
        size = 2 * struct.unpack_from(">i", shp, at + 4)[0]
        if size < 4 or at + 8 + size > len(shp):
            raise ValueError(f"broken record at {at}")
        yield shp[at + 8 : at + 8 + size]
        at += 8 + size


def attributes(dbf: bytes, encoding: str = "utf-8") -> list[dict[str, str] | None]:
    """Texts of the fields of each row of a .dbf file, without blanks around them; None for a deleted row."""
    n, head, width = struct.unpack_from("<IHH", dbf, 4)
    fields, at, place = [], 32, 1
    while at + 32 <= head and dbf[at] != 0x0D:
        fields.append((dbf[at : at + 11].split(b"\0")[0].decode("ascii", "replace"), place, dbf[at + 16]))
        place += dbf[at + 16]
        at += 32
    rows = (dbf[head + width * i : head + width * (i + 1)] for i in range(min(n, max(0, (len(dbf) - head) // max(width, 1)))))
    return [None if row[:1] == b"*" else {name: row[start : start + size].decode(encoding, "replace").strip(" \0") for name, start, size in fields} for row in rows]


def layers(name: str, data: bytes) -> Iterator[tuple[str, bytes, bytes]]:
    """Name, .shp and .dbf of each layer of a zip file, or of a bare .shp file, which has no attributes."""
    if not data.startswith(b"PK"):
        yield name.rsplit("/", 1)[-1].rsplit(".", 1)[0], data, b""
        return
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = {n.lower(): n for n in z.namelist() if not n.startswith("__MACOSX/")}
        for low, n in sorted(names.items()):
            if low.endswith(".shp"):
                dbf = names.get(low[:-4] + ".dbf")
                yield n[:-4], z.read(n), z.read(dbf) if dbf else b""


def parse(name: str, data: bytes) -> Iterator[tuple]:
    """Rows (layer, n, kind, parts, attributes, problem); what can't be read ends its layer with a row that says so, and deleted rows go."""
    try:
        for layer, shp, dbf in layers(name, data):
            n = -1
            try:
                rows = attributes(dbf) if dbf else None
                for n, body in enumerate(records(shp)):
                    kind, parts = shape(body)
                    told = rows[n] if rows is not None and n < len(rows) else {}
                    if told is not None:
                        yield layer, n, kind, parts, told, None
            except (ValueError, struct.error) as e:
                yield layer, n + 1, None, None, {}, str(e)
    except (zipfile.BadZipFile, zipfile.LargeZipFile, NotImplementedError, RuntimeError, EOFError) as e:
        yield None, None, None, None, {}, str(e)


def shapefiles(spark: SparkSession, path: str, most: int = 5000) -> DataFrame:
    """Rows (path, layer, n, kind, parts, attributes, problem) of the .zip and .shp files under a folder, n counting a layer's records from 0.

    parts holds a record's points, lines or rings as structs (x, y); heights and measures are passed over. A file is read whole, in one task, and
    its rows leave it in batches of `most`.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{zip,shp,ZIP,SHP}").load(path).select("path", "content")
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    kinds = pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.list_(point)), pa.map_(pa.string(), pa.string()), pa.string()
    names = ["path", "layer", "n", "kind", "parts", "attributes", "problem"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array([list(v.items()) for v in c] if pa.types.is_map(k) else list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held: list[tuple] = []
                for row in parse(name, content.as_buffer().to_pybytes()):
                    held.append((name, *row))
                    if len(held) >= most:
                        yield batch(held)
                        held = []
                if held:
                    yield batch(held)

    return files.mapInArrow(run, f"path string, {SHAPE}")
