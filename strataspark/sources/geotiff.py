"""Single-band GeoTIFF as a Spark data source: little-endian, uncompressed, in strips.

``spark.read.format("geotiff").load(path)`` gives (row, col, x, y, z), one
partition per strip group; ``df.write.format("geotiff").option(...)`` writes
pixel rows.  Register with ``register(spark)``.  Each write task leaves the
rows that it holds as fragments in the target folder; the commit lays them
out, strip by strip, in one file, so no task holds the raster.
"""

from __future__ import annotations

import math
import os
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Coordinate systems that may be written, and whether they are geographic.
EPSG = {4326: True, 4269: True, 3978: False, 3979: False, 32615: False, 32616: False, 32617: False, 3857: False}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I", 12: "d"}


def geo_keys(epsg: int) -> list[int]:
    if epsg not in EPSG:
        raise ValueError(f"EPSG:{epsg} is unknown here")
    geographic = EPSG[epsg]
    keys = [(1024, 2 if geographic else 1), (1025, 1), (2048 if geographic else 3072, epsg)]
    return [1, 1, 0, len(keys), *[x for k, v in keys for x in (k, 0, 1, v)]]


@dataclass
class Header:
    nx: int
    ny: int
    xres: float
    yres: float
    xmin: float
    ymax: float
    epsg: int
    dtype: str = "float32"
    nodata: float = -9999.0
    strip_rows: int = 64
    offsets: list[int] = field(default_factory=list)

    @property
    def strips(self) -> int:
        return math.ceil(self.ny / self.strip_rows)

    def rows_of(self, strip: int) -> int:
        return min(self.strip_rows, self.ny - strip * self.strip_rows)

    def encode(self) -> bytes:
        """The file up to its first strip."""
        counts = [self.rows_of(s) * self.nx * 4 for s in range(self.strips)]
        nodata = (f"{self.nodata:g}" + "\0").encode()
        tags = [
            (256, 4, [self.nx]), (257, 4, [self.ny]), (258, 3, [32]), (259, 3, [1]), (262, 3, [1]), (273, 4, [0] * self.strips), (277, 3, [1]),
            (278, 4, [self.strip_rows]), (279, 4, counts), (284, 3, [1]), (339, 3, [3 if self.dtype == "float32" else 2]),
            (33550, 12, [self.xres, self.yres, 0.0]), (33922, 12, [0.0, 0.0, 0.0, self.xmin, self.ymax, 0.0]), (34735, 3, geo_keys(self.epsg)), (42113, 2, nodata),
        ]

        def layout(tags):
            at, entries, extra = 8 + 2 + 12 * len(tags) + 4, b"", b""
            for tag, kind, values in tags:
                data = values if kind == 2 else struct.pack(f"<{len(values)}{_CODES[kind]}", *values)
                if len(data) <= 4:
                    entries += struct.pack("<HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
                else:
                    entries += struct.pack("<HHII", tag, kind, len(values), at + len(extra))
                    extra += data + b"\0" * (len(data) % 2)
            return struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + extra

        start = len(layout(tags))
        self.offsets = [start + sum(counts[:s]) for s in range(self.strips)]
        return layout([(t, k, self.offsets if t == 273 else v) for t, k, v in tags])

    @classmethod
    def decode(cls, data: bytes) -> "Header":
        order, magic, at = struct.unpack("<2sHI", data[:8])
        if order != b"II" or magic != 42:
            raise ValueError("not a little-endian TIFF")
        tags = {}
        for k in range(struct.unpack("<H", data[at : at + 2])[0]):
            tag, kind, n, where = struct.unpack("<HHII", data[at + 2 + 12 * k : at + 14 + 12 * k])
            if kind not in _SIZES:
                continue
            size = n * _SIZES[kind]
            raw = data[at + 10 + 12 * k : at + 10 + 12 * k + size] if size <= 4 else data[where : where + size]
            tags[tag] = raw if kind == 2 else struct.unpack(f"<{n}{_CODES[kind]}", raw)
        if tags.get(259, (1,))[0] != 1 or tags[258][0] != 32:
            raise ValueError("only uncompressed 32-bit bands are read")
        keys = tags.get(34735, ())
        epsg = next((keys[i + 3] for i in range(4, len(keys), 4) if keys[i] in (2048, 3072)), 0)
        return cls(tags[256][0], tags[257][0], tags[33550][0], tags[33550][1], tags[33922][3], tags[33922][4], epsg, "float32" if tags.get(339, (1,))[0] == 3 else "int32", float(tags[42113].rstrip(b"\0")) if 42113 in tags else math.nan, tags.get(278, (tags[257][0],))[0], list(tags[273]))


@dataclass
class _Strips(InputPartition):
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, per: int):
        self.path, self.per = path.removeprefix("file://"), per

    def _header(self) -> Header:
        with open(self.path, "rb") as f:
            return Header.decode(f.read(1 << 20))

    def partitions(self):
        n = self._header().strips
        return [_Strips(s, min(s + self.per, n)) for s in range(0, n, self.per)]

    def read(self, partition):
        h = self._header()
        with open(self.path, "rb") as f:
            for s in range(partition.first, partition.last):
                f.seek(h.offsets[s])
                z = np.frombuffer(f.read(h.rows_of(s) * h.nx * 4), f"<{'f4' if h.dtype == 'float32' else 'i4'}").astype(float)
                i = np.arange(len(z))
                r, c = s * h.strip_rows + i // h.nx, i % h.nx
                columns = [pa.array(r, pa.int32()), pa.array(c, pa.int32()), pa.array(h.xmin + (c + 0.5) * h.xres), pa.array(h.ymax - (r + 0.5) * h.yres), pa.array(z, mask=(z == h.nodata) | np.isnan(z))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "col", "x", "y", "z"])


@dataclass
class _Done(WriterCommitMessage):
    path: str


class _Writer(DataSourceWriter):
    """Tasks write fragments of (cell number, value); the folder must be shared by driver and executors."""

    def __init__(self, options: dict):
        o = {k.lower(): v for k, v in options.items()}
        self.path = o["path"].removeprefix("file://")
        self.header = Header(int(o["nx"]), int(o["ny"]), float(o["xres"]), float(o["yres"]), float(o["xmin"]), float(o["ymax"]), int(o.get("epsg", 4326)), o.get("datatype", "float32"), float(o.get("nodata", -9999)), int(o.get("striprows", 64)))
        geo_keys(self.header.epsg)

    def write(self, iterator):
        from pyspark import TaskContext

        h = self.header
        cells, values = [], []
        for r in iterator:
            z = r["z"]
            if not (0 <= r["row"] < h.ny and 0 <= r["col"] < h.nx):
                raise ValueError("a pixel lies outside the grid")
            cells.append(r["row"] * h.nx + r["col"])
            values.append(h.nodata if z is None or z != z else z)
        t = TaskContext.get()
        part = f"{self.path}.part-{t.partitionId()}-{t.taskAttemptId()}.npz"
        np.savez(part, cell=np.array(cells, np.int64), value=np.array(values, np.float64))
        return _Done(part)

    def commit(self, messages):
        h = self.header
        kind = "<f4" if h.dtype == "float32" else "<i4"
        head = h.encode()
        with open(self.path + ".tmp", "wb") as f:
            f.write(head)
            f.truncate(len(head) + h.nx * h.ny * 4)
        band = np.memmap(self.path + ".tmp", kind, "r+", len(head), (h.nx * h.ny,))
        band[:] = h.nodata
        for m in messages:
            with np.load(m.path) as part:
                band[part["cell"]] = part["value"].astype(kind)
            os.remove(m.path)
        band.flush()
        del band
        os.replace(self.path + ".tmp", self.path)

    def abort(self, messages):
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class GeoTiff(DataSource):
    @classmethod
    def name(cls):
        return "geotiff"

    def schema(self):
        return "row int, col int, x double, y double, z double"

    def reader(self, schema: StructType):
        return _Reader(self.options["path"], int(self.options.get("strips", 8)))

    def writer(self, schema: StructType, overwrite: bool):
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoTiff)
