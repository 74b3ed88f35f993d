"""Text and archive forms of vector and set data."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _unpacked(spark: SparkSession, path: str, schema: str, unpack) -> DataFrame:
    """unpack(bytes) -> record batches, for each file at path; a file is a task's work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                yield from unpack(content.as_py())

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def _vectors(x: np.ndarray, first: int = 0) -> pa.RecordBatch:
    flat = pa.array(x.astype(np.float32).ravel())
    cut = pa.array(np.arange(0, x.size + 1, x.shape[1] or 1)[: len(x) + 1], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(x))), pa.ListArray.from_arrays(cut, flat)], ["vec_id", "embedding"])


def tar_vecs(spark: SparkSession, path: str, member: str) -> DataFrame:
    """fvecs inside a tar (or tar.gz)."""

    def unpack(data: bytes):
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            raw = t.extractfile(member).read()
        dim = int(np.frombuffer(raw, "<i4", 1)[0])
        yield _vectors(np.frombuffer(raw, "<f4").reshape(-1, dim + 1)[:, 1:])

    return _unpacked(spark, path, "vec_id long, embedding array<float>", unpack)


def idx(spark: SparkSession, path: str) -> DataFrame:
    """IDX files (gzip or plain) of unsigned bytes, each item flattened."""

    def unpack(data: bytes):
        data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
        kind, axes = data[2], data[3]
        if kind != 8:
            raise ValueError(f"IDX type {kind} is not unsigned bytes")
        shape = np.frombuffer(data, ">u4", axes, 4)
        yield _vectors(np.frombuffer(data, np.uint8, offset=4 + 4 * axes).reshape(int(shape[0]), -1))

    return _unpacked(spark, path, "vec_id long, embedding array<float>", unpack)


def glove(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """Lines "word v1 v2 ...", plain or inside a zip: word, embedding."""
    if member is None:
        parts = F.split("value", " ")
        return spark.read.text(path).select(parts[0].alias("word"), F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda x: x.cast("float")).alias("embedding"))

    def unpack(data: bytes):
        with zipfile.ZipFile(io.BytesIO(data)) as z, z.open(member) as f:
            rows = [line.decode().rstrip("\n").split(" ") for line in f]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([list(map(float, r[1:])) for r in rows], pa.list_(pa.float32()))], ["word", "embedding"])

    return _unpacked(spark, path, "word string, embedding array<float>", unpack)


def bag_of_words(spark: SparkSession, path: str) -> DataFrame:
    """Triples "doc word count" after three header lines: id, term, tf."""
    parts = F.split("value", " ")
    return spark.read.text(path).where(F.size(parts) == 3).select(parts[0].cast("long").alias("id"), parts[1].cast("long").alias("term"), parts[2].cast("long").alias("tf"))


def ratings(spark: SparkSession, path: str, separator: str = "::", header: bool = False, least: float = 3.0) -> DataFrame:
    """user, item, rating of at least `least`; lines that do not parse are left out."""
    rows = spark.read.option("sep", separator).option("header", header).schema("user long, item long, rating double").csv(path)
    return rows.where((F.col("rating") >= least) & F.col("user").isNotNull() & F.col("item").isNotNull())


def transactions(spark: SparkSession, path: str, least: int = 20) -> DataFrame:
    """Lines of ints: items (distinct, ascending) of at least `least`."""
    items = F.array_sort(F.array_distinct(F.transform(F.filter(F.split(F.trim("value"), "\\s+"), lambda x: x != ""), lambda x: x.cast("int"))))
    return spark.read.text(path).select(items.alias("items")).where(F.size("items") >= least)


def bit_strings(spark: SparkSession, path: str) -> DataFrame:
    """Lines of 0 and 1: bits (array of booleans)."""
    return spark.read.text(path).select(F.transform(F.filter(F.split("value", ""), lambda c: c.isin("0", "1")), lambda c: c == "1").alias("bits"))


def stocks(spark: SparkSession, path: str, year: int) -> DataFrame:
    """CSV files with a Date column, of one year; the file's name is the ticker."""
    rows = spark.read.option("header", True).option("inferSchema", False).csv(path).withColumn("date", F.to_date("Date"))
    return rows.where(F.year("date") == year).withColumn("ticker", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1))


def gray_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as gray pixel vectors: origin, embedding (mean of the colour channels, 0..255)."""
    i = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for origin, channels, data in zip(b.column("origin").to_pylist(), b.column("nChannels").to_pylist(), b.column("data"), strict=True):
                x = np.frombuffer(data.as_py(), np.uint8).reshape(-1, channels)[:, : min(3, channels)].mean(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([origin]), pa.array([x.astype(np.float32)], pa.list_(pa.float32()))], ["origin", "embedding"])

    return i.select("origin", "nChannels", "data").mapInArrow(run, "origin string, embedding array<float>")


def hdf5(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """train, test, neighbors and distances of an HDF5 container, where h5py is installed."""
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("HDF5 containers need h5py; Parquet is this library's own container") from e
    with h5py.File(path) as f:
        return {k: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(f[k])], "vec_id long, embedding array<double>") for k in f}
