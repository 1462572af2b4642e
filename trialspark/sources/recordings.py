"""Acquisition recordings: raw sample files, their names, headers and byte ranges, as a Spark data source.

A file is an 8-byte little-endian timestamp and then rows of little-endian samples, one per channel.  Its name tells source,
channels, type and order: ``{source}_{channels}_Channels_{type}_{timestamp}.bin``.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

HEADER = 8
NAME = re.compile(r"(?P<source>\w+?)_(?P<channels>\d+)_Channels_(?P<kind>\w+?)_(?P<stamp>[\w-]+)\.bin$")
# Numpy code of each type in names, and volts per bit by source.
TYPES = {"int16": "<i2", "int32": "<i4", "int64": "<i8", "uint16": "<u2", "uint64": "<u8", "float32": "<f4", "float64": "<f8"}
VOLTS = {"Headstages": 1.907e-7, "AnalogPanel": 3.0517578125e-4}


@dataclass(frozen=True)
class File:
    path: str
    source: str
    channels: int
    kind: str
    stamp: str
    rows: int


def _fs(path: str):
    return pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def list_files(path: str, source: str | None = None) -> list[File]:
    """Files of a folder by name; those whose name doesn't fit are left out."""
    fs, base = _fs(path)
    out = []
    for info in fs.get_file_info(pafs.FileSelector(base, allow_not_found=False)):
        m = NAME.search(info.base_name)
        if m and m["kind"] in TYPES and (source is None or m["source"] == source):
            width = 1 if m["source"] == "DigitalPanel" and m["kind"] == "uint64" else int(m["channels"])
            out.append(File(info.path, m["source"], int(m["channels"]), m["kind"], m["stamp"], (info.size - HEADER) // (width * np.dtype(TYPES[m["kind"]]).itemsize)))
    return sorted(out, key=lambda f: (f.source, f.stamp))


def list_sources(path: str) -> list[str]:
    return sorted({f.source for f in list_files(path)})


def metadata(path: str, source: str) -> dict:
    """Channels, samples over all files, and volts per bit of a source; an unknown one raises."""
    files = list_files(path, source)
    if not files:
        raise FileNotFoundError(f"no {source} files in {path}")
    return {"source": source, "n_channels": files[0].channels, "n_samples": sum(f.rows for f in files), "voltsperbit": VOLTS.get(source)}


class RecordingSource(DataSource):
    """``spark.read.format("recording").option("source", ...).load(folder)``: ``(source, file, i, values)``.

    ``i`` runs over the source's files in order.  Options: ``source``; ``channels`` (comma-separated, from 0), read alone;
    ``chunk`` rows a partition; ``start`` and ``end`` rows, so that a segment reads only its bytes.
    """

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> StructType:
        return StructType([StructField("source", StringType()), StructField("file", StringType()), StructField("i", LongType()), StructField("values", ArrayType(DoubleType()))])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


@dataclass
class _Range(InputPartition):
    path: str
    source: str
    channels: int
    kind: str
    first: int
    at: int
    rows: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        picked = options.get("channels")
        self.picked = [int(c) for c in picked.split(",")] if picked else None

    def partitions(self) -> list[InputPartition]:
        chunk = int(self.options.get("chunk", 1 << 18))
        lo, hi = int(self.options.get("start", 0)), int(self.options.get("end", 1 << 62))
        out, before, last = [], 0, None
        for f in list_files(self.options["path"], self.options.get("source")):
            before = before if f.source == last else 0
            last = f.source
            a, b = max(0, lo - before), min(f.rows, hi - before)
            out += [_Range(f.path, f.source, f.channels, f.kind, before + r, r, min(chunk, b - r)) for r in range(a, b, chunk)]
            before += f.rows
        return out

    def read(self, partition: _Range):
        fs, _ = _fs(self.options["path"])
        kind = np.dtype(TYPES[partition.kind])
        width = 1 if partition.source == "DigitalPanel" and partition.kind == "uint64" else partition.channels
        with fs.open_input_file(partition.path) as f:
            for r in range(0, partition.rows, 1 << 14):
                n = min(1 << 14, partition.rows - r)
                raw = f.read_at(n * width * kind.itemsize, HEADER + (partition.at + r) * width * kind.itemsize)
                x = np.frombuffer(raw, kind).reshape(-1, width)
                if len(x) != n:
                    raise OSError(f"{partition.path} is shorter than its size said")
                x = x if self.picked is None else x[:, self.picked]
                off = pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array([partition.source] * n), pa.array([partition.path] * n), pa.array(np.arange(n) + partition.first + r), pa.ListArray.from_arrays(off, pa.array(x.astype(float).ravel()))], ["source", "file", "i", "values"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordingSource)


def read(spark: SparkSession, path: str, source: str, channels: list[int] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    register(spark)
    r = spark.read.format("recording").option("source", source)
    if channels:
        r = r.option("channels", ",".join(map(str, channels)))
    if start is not None:
        r = r.option("start", start)
    if end is not None:
        r = r.option("end", end)
    return r.load(path)


def long(recording: DataFrame) -> DataFrame:
    """``(source, i, channel, value)``."""
    return recording.select("source", "i", F.posexplode("values").alias("channel", "value"))


def write(data: np.ndarray, folder: str, source: str = "Headstages", voltsperbit: float = 1.907e-7, stamp: str = "2000-01-01_00-00-00", timestamp: int = 0) -> str:
    """A small recording (samples x channels, volts) as an int16 file, for fixtures."""
    fs, base = _fs(folder)
    fs.create_dir(base, recursive=True)
    path = f"{base}/{source}_{data.shape[1]}_Channels_int16_{stamp}.bin"
    with fs.open_output_stream(path) as f:
        f.write(np.uint64(timestamp).tobytes() + np.rint(np.asarray(data) / voltsperbit).astype("<i2").tobytes())
    return path


def recordings(files: DataFrame) -> DataFrame:
    """Files ``(source, channels, stamp, rows)`` folded into recordings: consecutive ones of a source with as many channels."""
    w = Window.partitionBy("source").orderBy("stamp")
    x = files.withColumn("__new", (~F.col("channels").eqNullSafe(F.lag("channels").over(w))).cast("int"))
    x = x.withColumn("recording", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("source", "recording").agg(F.first("channels").alias("channels"), F.min("stamp").alias("stamp"), F.count("*").alias("files"), F.sum("rows").alias("rows"))
