"""Raw rasters and file digests as Python data sources: row ranges are partitions, row filters skip ranges.

``spark.read.format("raw_raster")`` gives (layer_id, row, heights) from one row-major file or from a folder of files
``rows-<first row>.raw``; writing makes such a folder per layer, one file per run of consecutive rows in a task.
A file is never read whole: a partition is a range of rows, read in blocks of a few.  Files are opened
through ``pyarrow.fs``, so paths may be local, shared or in an object store.

Options: path, width, dtype (f4, i2 or u2), endian (little or big), scale, missing (the constant that stands for no
data), layer_id, partition_rows.  A file whose length is no multiple of a row is an error.  NaN and the missing constant
become null heights and are written back as such.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual,
    WriterCommitMessage,
)

BLOCK_ROWS = 64
PARTITION_BYTES = 8 << 20
RANGE_BYTES = 64 << 20
SCHEMA = "layer_id string, row long, heights array<float>"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[pafs.FileInfo]:
    """The file itself, or every file below a folder, in order of path; none where nothing is."""
    fs, at = _open(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [info]
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True))
    return sorted((x for x in found if x.type == pafs.FileType.File and not x.base_name.startswith((".", "_"))), key=lambda x: x.path)


@dataclass
class Layout:
    """How samples lie in a file."""

    width: int
    dtype: str
    scale: float
    missing: int | None

    @staticmethod
    def of(options: dict) -> Layout:
        kind = options.get("dtype", "f4")
        if kind not in ("f4", "i2", "u2"):
            raise ValueError(f"dtype {kind} is none of f4, i2, u2")
        order = {"little": "<", "big": ">"}[options.get("endian", "little")]
        missing = options.get("missing")
        return Layout(int(options["width"]), order + kind, float(options.get("scale", 1.0)), None if missing is None else int(missing))

    @property
    def row_bytes(self) -> int:
        return self.width * np.dtype(self.dtype).itemsize

    def decoded(self, body: bytes) -> pa.ListArray:
        raw = np.frombuffer(body, self.dtype)
        values = raw.astype(np.float64) * self.scale
        bad = np.isnan(values) if self.missing is None else raw == self.missing
        ends = pa.array(np.arange(len(raw) // self.width + 1, dtype=np.int32) * self.width)
        return pa.ListArray.from_arrays(ends, pa.array(values.astype(np.float32), mask=bad))

    def encoded(self, heights: pa.Array) -> bytes:
        flat = heights.flatten()
        if len(flat) != len(heights) * self.width:
            raise ValueError(f"rows must hold {self.width} samples")
        values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
        if self.dtype.endswith("f4"):
            return (values / self.scale).astype(self.dtype).tobytes()
        bad = np.isnan(values)
        if bad.any() and self.missing is None:
            raise ValueError("integers need a constant for missing samples")
        whole = np.floor(np.where(bad, 0.0, values / self.scale) + 0.5)
        limits = np.iinfo(np.dtype(self.dtype))
        if len(whole) and not (limits.min <= whole.min() and whole.max() <= limits.max):
            raise ValueError(f"heights do not fit {self.dtype} at scale {self.scale}")
        return np.where(bad, self.missing or 0, whole).astype(self.dtype).tobytes()


@dataclass
class RowRange(InputPartition):
    path: str
    at: int  # first row in the file
    rows: int
    first: int  # number of that row in the raster

    def __init__(self, path: str, at: int, rows: int, first: int):
        super().__init__(None)
        self.path, self.at, self.rows, self.first = path, at, rows, first


class RawReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.layout, self.layer = options["path"], Layout.of(options), options.get("layer_id", "")
        self.rows = int(options.get("partition_rows", max(1, PARTITION_BYTES // self.layout.row_bytes)))
        self.low, self.high = 0, 2**62  # rows wanted, end exclusive

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            kind, value = type(f), getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("row",) or not isinstance(value, int):
                yield f
            elif kind is EqualTo:
                self.low, self.high = max(self.low, value), min(self.high, value + 1)
            elif kind in (GreaterThan, GreaterThanOrEqual):
                self.low = max(self.low, value + (kind is GreaterThan))
            elif kind in (LessThan, LessThanOrEqual):
                self.high = min(self.high, value + (kind is LessThanOrEqual))
            else:
                yield f

    def partitions(self) -> list[RowRange]:
        out = []
        for info in _files(self.path):
            if info.size % self.layout.row_bytes:
                raise ValueError(f"{info.path}: {info.size} bytes are no whole rows of {self.layout.row_bytes}")
            named = re.fullmatch(r"rows-(\d+)\.raw", info.base_name)
            start, rows = int(named[1]) if named else 0, info.size // self.layout.row_bytes
            a, b = max(0, self.low - start), min(rows, self.high - start)
            out += [RowRange(info.path, i, min(self.rows, b - i), start + i) for i in range(a, b, self.rows)]
        return out

    def read(self, part: RowRange | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        fs, _ = _open(self.path)
        with fs.open_input_file(part.path) as f:
            for i in range(0, part.rows, BLOCK_ROWS):
                n = min(BLOCK_ROWS, part.rows - i)
                body = f.read_at(n * self.layout.row_bytes, (part.at + i) * self.layout.row_bytes)
                row = pa.array(np.arange(part.first + i, part.first + i + n))
                yield pa.RecordBatch.from_arrays([pa.array([self.layer] * n), row, self.layout.decoded(body)], names=["layer_id", "row", "heights"])


class RawWriter(DataSourceArrowWriter):
    """Writes runs of consecutive rows; a task that runs again writes the same files again."""

    def __init__(self, options: dict):
        self.path, self.layout = options["path"], Layout.of(options)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, at = _open(self.path)
        out, last = None, None
        for batch in batches:
            layer, row, heights = batch.column("layer_id").to_pylist(), batch.column("row").to_numpy(), batch.column("heights")
            cut = [0, *[i for i in range(1, len(row)) if layer[i] != layer[i - 1] or row[i] != row[i - 1] + 1], len(row)]
            for a, b in zip(cut, cut[1:]):
                if b <= a:
                    continue
                if last != (layer[a], int(row[a]) - 1):
                    if out:
                        out.close()
                    fs.create_dir(f"{at}/{layer[a]}", recursive=True)
                    out = fs.open_output_stream(f"{at}/{layer[a]}/rows-{int(row[a]):012d}.raw")
                out.write(self.layout.encoded(heights.slice(a, b - a)))
                last = (layer[a], int(row[b - 1]))
        if out:
            out.close()
        return WriterCommitMessage()


class RawRaster(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_raster"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RawReader:
        return RawReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> RawWriter:
        return RawWriter(dict(self.options))


@dataclass
class FileRanges(InputPartition):
    ranges: list[tuple[str, int, int, int]]  # path, first byte, length, size of the file

    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        super().__init__(None)
        self.ranges = ranges


class DigestReader(DataSourceReader):
    """Ranges in order of path and place, so many to a partition that it holds about ``partition_bytes``, however short they are."""

    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("range_bytes", RANGE_BYTES))
        self.bytes = int(options.get("partition_bytes", PARTITION_BYTES))

    def partitions(self) -> list[FileRanges]:
        out, held = [], 0
        for x in _files(self.path):
            for i in range(0, max(x.size, 1), self.step):
                length = min(self.step, x.size - i)
                # A file costs its opening, so empty ones weigh something too.
                if not out or held + length > self.bytes:
                    out.append([])
                    held = 0
                out[-1].append((x.path, i, length, x.size))
                held += max(length, 4096)
        return [FileRanges(r) for r in out]

    def read(self, part: FileRanges | None) -> Iterator[tuple]:
        if part is None:
            return
        fs, _ = _open(self.path)
        for path, ranges in itertools.groupby(part.ranges, lambda r: r[0]):
            with fs.open_input_file(path) as f:
                for _, at, length, size in ranges:
                    digest = hashlib.sha256()
                    for i in range(0, length, 1 << 20):
                        digest.update(f.read_at(min(1 << 20, length - i), at + i))
                    yield path, size, at, length, digest.hexdigest()


class FileDigests(DataSource):
    """SHA-256 of ranges of every file below a path; a range is streamed through, never held."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "path string, bytes long, at long, length long, sha256 string"

    def reader(self, schema) -> DigestReader:
        return DigestReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RawRaster)
    spark.dataSource.register(FileDigests)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_raw(spark: SparkSession, path: str, width: int, layer_id: str, **options) -> DataFrame:
    """Rows of a raw raster; conditions on ``row`` skip what they exclude before a byte is read."""
    register(spark)
    given = {k: str(v) for k, v in options.items() if v is not None}
    return spark.read.format("raw_raster").options(path=path, width=str(width), layer_id=layer_id, **given).load()


def write_raw(rows: DataFrame, path: str, width: int, **options) -> None:
    """One folder per layer below ``path``; rows are dealt out by ranges, so files follow each other without overlap."""
    register(rows.sparkSession)
    given = {k: str(v) for k, v in options.items() if v is not None}
    rows.select("layer_id", "row", "heights").repartitionByRange("layer_id", "row").sortWithinPartitions("layer_id", "row").write.format(
        "raw_raster").mode("append").options(path=path, width=str(width), **given).save()


def artifacts(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, bytes, available, ranges, sha256 of every file: its own digest, or for several ranges that of their digests in order."""
    register(spark)
    parts = spark.read.format("file_digests").options(path=path, range_bytes=str(range_bytes)).load()
    whole = F.transform(F.array_sort(F.collect_list(F.struct("at", "sha256"))), lambda x: x["sha256"])
    return parts.groupBy("path", "bytes").agg(F.count("*").alias("ranges"), whole.alias("_all")).select(
        "path", "bytes", (F.col("bytes") > 0).alias("available"), "ranges",
        F.when(F.col("ranges") == 1, F.col("_all")[0]).otherwise(F.sha2(F.array_join("_all", ""), 256)).alias("sha256"))
