"""Vector files as a Spark data source ("vecfiles"), read and written in parallel byte ranges.

Layouts: fvecs, ivecs, bvecs (every row led by an int32 dimension); fbin, ibin, u8bin, i8bin (uint32 rows and dimension,
then the rows). A path is a file, or a folder that this source wrote: parts in row order and _index.json. Paths go
through pyarrow's file systems (local, hdfs, s3, gcs).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Layout -> (component type, rows carry their dimension, Spark type).
LAYOUTS = {
    "fvecs": ("<f4", True, "float"),
    "ivecs": ("<i4", True, "int"),
    "bvecs": ("u1", True, "smallint"),
    "fbin": ("<f4", False, "float"),
    "ibin": ("<i4", False, "int"),
    "u8bin": ("u1", False, "smallint"),
    "i8bin": ("i1", False, "smallint"),
}
ARROW = {"float": pa.float32(), "int": pa.int32(), "smallint": pa.int16()}
ROWS_PER_PARTITION = 200_000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path)


def made(path: str) -> tuple[fs.FileSystem, str]:
    """opened, for a file to be written: its folder is there."""
    system, name = opened(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    return system, name


@dataclass
class Part(InputPartition):
    path: str
    offset: int
    rows: int
    dim: int
    first_id: int

    def __post_init__(self):
        super().__init__(0)


def layout_of(options: dict) -> str:
    layout = options.get("layout") or options["path"].rstrip("/").rsplit(".", 1)[-1]
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}; one of {', '.join(LAYOUTS)}")
    return layout


def header(path: str, layout: str) -> tuple[int, int, int]:
    """(rows, dimension, offset of the first row) of one file."""
    system, name = opened(path)
    kind, led, _ = LAYOUTS[layout]
    with system.open_input_file(name) as f:
        size = f.size()
        if led:
            if size < 4:
                return 0, 0, 0
            dim = int(np.frombuffer(f.read_at(4, 0), "<i4")[0])
            return size // (4 + dim * np.dtype(kind).itemsize), dim, 0
        rows, dim = np.frombuffer(f.read_at(8, 0), "<u4")
        there = (size - 8) // max(1, int(dim) * np.dtype(kind).itemsize)  # files may be cropped below their header
        return min(int(rows), there), int(dim), 8


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.layout = options, layout_of(options)
        self.kind, self.led, self.spark_type = LAYOUTS[self.layout]

    def files(self) -> list[str]:
        path = self.options["path"].rstrip("/")
        system, name = opened(path)
        if system.get_file_info(name).type != fs.FileType.Directory:
            return [path]
        with system.open_input_stream(name + "/_index.json") as f:
            return [f"{path}/{p}" for p in json.loads(f.read())["parts"]]

    def partitions(self) -> list[InputPartition]:
        """Options start and count choose a range of rows before anything is read."""
        start, left = int(self.options.get("start", 0)), int(self.options.get("count", 1 << 62))
        step = int(self.options.get("rows_per_partition", ROWS_PER_PARTITION))
        out, before = [], 0
        for path in self.files():
            rows, dim, offset = header(path, self.layout)
            width = dim * np.dtype(self.kind).itemsize + 4 * self.led
            at = max(0, start - before)
            while at < rows and left > 0:
                n = min(step, rows - at, left)
                out.append(Part(path, offset + at * width, n, dim, before + at))
                at, left = at + n, left - n
            before += rows
        return out or [Part("", 0, 0, 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        width = part.dim * np.dtype(self.kind).itemsize + 4 * self.led
        if not part.rows:
            return
        system, name = opened(part.path)
        with system.open_input_file(name) as f:
            step = max(1, (8 << 20) // max(1, width))
            for at in range(0, part.rows, step):
                n = min(step, part.rows - at)
                raw = np.frombuffer(f.read_at(n * width, part.offset + at * width), np.uint8).reshape(n, width)
                if self.led and not (raw[:, :4].copy().view("<i4") == part.dim).all():
                    raise ValueError(f"{part.path}: rows differ in dimension")
                x = np.ascontiguousarray(raw[:, 4 * self.led :]).view(self.kind).ravel()
                x = x.astype({"float": np.float32, "int": np.int32, "smallint": np.int16}[self.spark_type])
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, part.dim or 1)[: n + 1], pa.int32()), pa.array(x, ARROW[self.spark_type]))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.first_id + at, part.first_id + at + n)), values], ["vec_id", "embedding"])


@dataclass
class Wrote(WriterCommitMessage):
    name: str
    rows: int
    dim: int
    first: int


class Writer(DataSourceWriter):
    """Each task writes a part of its own; the driver lists them in row order when all are there."""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.layout, self.overwrite = options, layout_of(options), overwrite
        self.path = options["path"].rstrip("/")

    def write(self, rows) -> Wrote:
        kind, led, _ = LAYOUTS[self.layout]
        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        name, n, dim, first = f"part-{uuid.uuid4().hex}.{self.layout}", 0, 0, 0
        with system.open_output_stream(f"{folder}/{name}") as f:
            held: list[bytes] = []
            for r in rows:
                x = np.asarray(r["embedding"], kind)
                if n and len(x) != dim:
                    raise ValueError("rows differ in dimension")
                first, dim, n = (r["vec_id"] if not n else first), len(x), n + 1
                held.append((np.array([dim], "<i4").tobytes() if led else b"") + x.tobytes())
                if len(held) >= 4096:
                    f.write(b"".join(held))
                    held = []
            f.write(b"".join(held))
        if not led:  # the header goes in front once the count is known
            self._led(system, folder, name, n, dim)
        return Wrote(name, n, dim, first)

    @staticmethod
    def _led(system, folder: str, name: str, n: int, dim: int) -> None:
        with system.open_input_stream(f"{folder}/{name}") as f, system.open_output_stream(f"{folder}/{name}.tmp") as g:
            g.write(np.array([n, dim], "<u4").tobytes())
            while chunk := f.read(8 << 20):
                g.write(chunk)
        system.move(f"{folder}/{name}.tmp", f"{folder}/{name}")

    def commit(self, messages: list[Wrote]) -> None:
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.first)
        if len({m.dim for m in parts}) > 1:
            raise ValueError("rows differ in dimension")
        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/_index.json") as f:
            f.write(json.dumps({"layout": self.layout, "rows": sum(m.rows for m in parts), "dim": parts[0].dim if parts else 0, "parts": [m.name for m in parts]}).encode())
        for m in messages:
            if m and not m.rows:
                system.delete_file(f"{folder}/{m.name}")

    def abort(self, messages: list[Wrote]) -> None:
        system, folder = opened(self.path)
        for m in messages:
            if m:
                system.delete_file(f"{folder}/{m.name}")


class VecFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vecfiles"

    def schema(self) -> str:
        return f"vec_id long, embedding array<{LAYOUTS[layout_of(self.options)][2]}>"

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return Writer(dict(self.options), overwrite)


def read(spark: SparkSession, path: str, layout: str | None = None, start: int = 0, count: int | None = None, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """(vec_id, embedding); vec_id is the row's number. Only the rows of the range are read."""
    spark.dataSource.register(VecFiles)
    r = spark.read.format("vecfiles").option("start", start).option("rows_per_partition", rows_per_partition)
    r = r.option("layout", layout) if layout else r
    return (r.option("count", count) if count is not None else r).load(path)


def write(vectors: DataFrame, path: str, layout: str) -> None:
    """A folder of parts in vec_id order; ids themselves are not stored. Rows must have one dimension."""
    vectors.sparkSession.dataSource.register(VecFiles)
    kind = LAYOUTS[layout][2]
    rows = vectors.selectExpr("cast(vec_id as long) as vec_id", f"cast(embedding as array<{kind}>) as embedding")
    rows = rows.repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    rows.write.format("vecfiles").option("layout", layout).mode("append").save(path)


def joined(path: str, out: str) -> None:
    """The parts of a written folder as one file (led layouts: their concatenation)."""
    system, folder = opened(path)
    with system.open_input_stream(folder + "/_index.json") as f:
        index = json.loads(f.read())
    led = LAYOUTS[index["layout"]][1]
    target, name = made(out)
    with target.open_output_stream(name) as g:
        if not led:
            g.write(np.array([index["rows"], index["dim"]], "<u4").tobytes())
        for part in index["parts"]:
            with system.open_input_stream(f"{folder}/{part}") as f:
                if not led:
                    f.read(8)
                while chunk := f.read(8 << 20):
                    g.write(chunk)
