"""Shapefiles of points: a small export as one file, which a writer takes from the driver's iterator, and exports of any size as zipped files of the tasks."""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import valid_coordinate
from .export import MOST_ROWS, guarded

#: Fixed value: the WGS84 projection.
PRJ = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
FIELDS = (("ID", 50), ("TYPE", 20), ("CLASS", 50), ("CONF", 6), ("DATE", 10))


def attributes(points: DataFrame) -> DataFrame:
    """points (id, type, class, confidence, date, lat, lon) as texts cut to their fields; confidence in whole per cent."""
    value = {"ID": F.col("id").cast("string"), "TYPE": F.col("type"), "CLASS": F.col("class"), "CONF": F.floor(F.col("confidence") * 100 + 0.5).cast("string"), "DATE": F.date_format("date", "yyyy-MM-dd")}
    return points.select("lat", "lon", *[F.coalesce(F.left(value[name], F.lit(size)), F.lit("")).alias(name) for name, size in FIELDS])


def write(points: DataFrame, path: str, most: int = MOST_ROWS) -> int:
    """Write path.shp, .shx, .dbf and .prj; returns the number of points."""
    shapes, rows = [], []
    for r in attributes(guarded(points, most)).toLocalIterator():
        shapes.append((r.lon, r.lat))
        rows.append(b" " + b"".join(r[name].encode("utf-8")[:size].ljust(size) for name, size in FIELDS))
    box = (min((x for x, _ in shapes), default=0.0), min((y for _, y in shapes), default=0.0), max((x for x, _ in shapes), default=0.0), max((y for _, y in shapes), default=0.0))
    head = lambda words: struct.pack(">i5ii", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<ii8d", 1000, 1, *box, 0, 0, 0, 0)
    base = Path(path)
    base.with_suffix(".shp").write_bytes(head(50 + 14 * len(shapes)) + b"".join(struct.pack(">ii", i + 1, 10) + struct.pack("<idd", 1, x, y) for i, (x, y) in enumerate(shapes)))
    base.with_suffix(".shx").write_bytes(head(50 + 4 * len(shapes)) + b"".join(struct.pack(">ii", 50 + 14 * i, 10) for i in range(len(shapes))))
    fields = b"".join(name.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([size, 0]) + bytes(14) for name, size in FIELDS)
    width = 1 + sum(size for _, size in FIELDS)
    base.with_suffix(".dbf").write_bytes(struct.pack("<BBBBIHH20x", 3, 124, 1, 1, len(rows), 33 + len(fields), width) + fields + b"\r" + b"".join(rows) + b"\x1a")
    base.with_suffix(".prj").write_text(PRJ)
    return len(shapes)


#: The fields of a whole export and their widths; numbers are right-aligned. Whole per cent of the levels of labels by hand.
ALL_FIELDS = (("ID", "C", 50), ("CLASS", "C", 50), ("CONFIDENCE", "N", 10), ("TYPE", "C", 10), ("ASSET", "C", 100), ("PROJECT", "C", 50), ("LOCATION", "C", 100), ("NOTES", "C", 254), ("CREATED", "C", 10))
LEVELS = {"CERTAIN": 100, "LIKELY": 75, "UNCERTAIN": 50}
#: Points of a file.
FILE_ROWS = 100_000


def features(detections: DataFrame, manual: DataFrame) -> DataFrame:
    """Rows (lat, lon, the fields of ALL_FIELDS) of detections (id, class, confidence, asset, project, location, notes, created, lat, lon) and labels by hand (the same, with a level as confidence).

    Texts are cut to their widths, null ones are empty, a null confidence or unknown level is 0; rows without a valid place go.
    """
    share = F.floor(F.coalesce("confidence", F.lit(0.0)) * 100 + 0.5)
    level = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), F.col("confidence")), F.lit(0))

    def rows(df: DataFrame, kind: str, confidence: Column) -> DataFrame:
        value = {"ID": F.col("id").cast("string"), "CLASS": F.col("class"), "CONFIDENCE": confidence.cast("string"), "TYPE": F.lit(kind), "ASSET": F.col("asset"), "PROJECT": F.col("project"), "LOCATION": F.col("location"), "NOTES": F.col("notes"), "CREATED": F.date_format("created", "yyyy-MM-dd")}
        return df.where(valid_coordinate(F.col("lat"), F.col("lon"))).select("lat", "lon", *[F.coalesce(F.left(value[name], F.lit(size)), F.lit("")).alias(name) for name, _, size in ALL_FIELDS])

    return rows(detections, "AI", share).unionByName(rows(manual, "Manual", level))


def _files(lons: np.ndarray, lats: np.ndarray, columns: list[pa.Array]) -> dict[str, bytes]:
    """The files of a shapefile of points by their endings; a column's text is padded once for all rows that have it."""
    n = len(lons)
    box = lons.min(), lats.min(), lons.max(), lats.max()
    head = lambda words: struct.pack(">i5ii", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<ii8d", 1000, 1, *box, 0, 0, 0, 0)
    shp, shx = np.empty(n, ">i4,>i4,<i4,<f8,<f8"), np.empty(n, ">i4,>i4")
    for at, value in enumerate((np.arange(1, n + 1), 10, 1, lons, lats)):
        shp[f"f{at}"] = value
    shx["f0"], shx["f1"] = 50 + 14 * np.arange(n), 10
    fields = b"".join(name.encode().ljust(11, b"\0") + kind.encode() + bytes(4) + bytes([size, 0]) + bytes(14) for name, kind, size in ALL_FIELDS)
    width = 1 + sum(size for _, _, size in ALL_FIELDS)

    def told(value: str, kind: str, size: int) -> bytes:
        data = value.encode()[:size].decode("utf-8", "ignore").encode()  # no character is cut in two
        return data.rjust(size) if kind == "N" else data.ljust(size)

    rows = np.full(n, b" ", [("mark", "S1"), *((name, f"S{size}") for name, _, size in ALL_FIELDS)])
    for c, (name, kind, size) in zip(columns, ALL_FIELDS, strict=True):
        texts = c.dictionary_encode()
        rows[name] = np.array([told(v, kind, size) for v in texts.dictionary.to_pylist()], f"S{size}")[texts.indices.to_numpy()]
    dbf = struct.pack("<BBBBIHH20x", 3, 124, 1, 1, n, 33 + len(fields), width) + fields + b"\r" + rows.tobytes() + b"\x1a"
    return {"shp": head(50 + 14 * n) + shp.tobytes(), "shx": head(50 + 4 * n) + shx.tobytes(), "dbf": dbf, "prj": PRJ.encode(), "cpg": b"UTF-8"}


def write_zipped(found: DataFrame, folder: str, most: int = FILE_ROWS) -> DataFrame:
    """Write zipped shapefiles of up to `most` of the features each; the result lists rows (path, n). Tasks write as it is read.

    A shapefile's header tells its size and extent, so an export of any size is many whole files. A repeated task replaces its files.
    """
    names = [name for name, _, _ in ALL_FIELDS]

    def put(fs: pafs.FileSystem, base: str, place: int, part: int, table: pa.Table) -> pa.RecordBatch:
        name, temporary = f"{base}/detections-{place:05d}-{part:05d}.zip", f"{base}/.{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(temporary) as f:
            packed = io.BytesIO()
            with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
                for ending, data in _files(table["lon"].to_numpy(), table["lat"].to_numpy(), [table[c].combine_chunks() for c in names]).items():
                    z.writestr(f"detections/detections.{ending}", data)
            f.write(packed.getvalue())
        fs.move(temporary, name)
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([table.num_rows], pa.int64())], names=["path", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        place, part, held, n = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            while b.num_rows:
                held.append(b.slice(0, most - n))
                n, b = n + held[-1].num_rows, b.slice(min(most - n, b.num_rows))
                if n >= most:
                    yield put(fs, base, place, part, pa.Table.from_batches(held))
                    part, held, n = part + 1, [], 0
        if held:
            yield put(fs, base, place, part, pa.Table.from_batches(held))

    return found.select("lat", "lon", *names).mapInArrow(run, "path string, n long")
