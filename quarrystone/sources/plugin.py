"""Formats of one's own as Spark data sources: a subclass of PointFiles names its extension and turns a file's bytes into
columns and back; ``spark.dataSource.register`` makes ``spark.read.format(name)`` and ``df.write.format(name)`` know it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quarrystone.sources import formats

#: Points of a written file, and of a batch that is read.
FILE_POINTS, BATCH_POINTS = 500_000, 50_000


class PointFiles(DataSource):
    """A folder of point files, a task a file. Columns: path, x, y, z, cls, intensity."""

    extension = ""

    @staticmethod
    def decode(data: bytes) -> dict[str, np.ndarray]:
        raise NotImplementedError

    @staticmethod
    def encode(points: pd.DataFrame) -> bytes:
        raise NotImplementedError

    def schema(self) -> str:
        return "path string, x double, y double, z double, cls int, intensity int"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(type(self), self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(type(self), self.options["path"], overwrite)


@dataclass
class _File(InputPartition):
    path: str


def _own(fs: pafs.FileSystem, root: str, extension: str) -> list[str]:
    """The files of a format in a folder; names that begin with a dot or a low line are no data."""
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted(f.path for f in found if f.type == pafs.FileType.File and f.base_name.lower().endswith("." + extension) and f.base_name[0] not in "._")


class _Reader(DataSourceReader):
    def __init__(self, source: type[PointFiles], folder: str):
        self.source, self.folder = source, folder

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in _own(*pafs.FileSystem.from_uri(self.folder), self.source.extension)]

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without files
            return
        fs, _ = pafs.FileSystem.from_uri(self.folder)
        with fs.open_input_file(partition.path) as f:
            v = self.source.decode(f.read())
        n = len(v["x"])
        for at in range(0, n, BATCH_POINTS):
            part = slice(at, at + BATCH_POINTS)
            columns = [pa.array([partition.path] * len(v["x"][part]), pa.string()), *[pa.array(v[a][part].astype(float)) for a in "xyz"], *[pa.array(v[c][part].astype(np.int32)) for c in ("cls", "intensity")]]
            yield pa.RecordBatch.from_arrays(columns, ["path", "x", "y", "z", "cls", "intensity"])


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceArrowWriter):
    """Tasks write files under hidden names; the names of those that succeeded are made visible at the end."""

    def __init__(self, source: type[PointFiles], folder: str, overwrite: bool):
        self.source, self.folder, self.overwrite = source, folder, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        fs.create_dir(root, recursive=True)
        names, held, n = [], [], 0

        def flush() -> None:
            nonlocal held, n
            if n:
                names.append(f"{uuid.uuid4().hex}.{self.source.extension}")
                with fs.open_output_stream(f"{root}/.{names[-1]}") as out:
                    out.write(self.source.encode(pa.Table.from_batches(held).to_pandas()))
            held, n = [], 0

        for batch in iterator:
            for at in range(0, batch.num_rows, FILE_POINTS):
                part = batch.slice(at, FILE_POINTS)
                if n + part.num_rows > FILE_POINTS:
                    flush()
                held.append(part)
                n += part.num_rows
        flush()
        return _Written(names)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        for path in _own(fs, root, self.source.extension) if self.overwrite else []:
            fs.delete_file(path)
        for name in (n for m in messages if m for n in m.names):
            fs.move(f"{root}/.{name}", f"{root}/{name}")

    def abort(self, messages: list[_Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        for name in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{root}/.{name}")


class LasPoints(PointFiles):
    """LAS files as ``las_points``."""

    extension = "las"

    @classmethod
    def name(cls) -> str:
        return "las_points"

    @staticmethod
    def decode(data: bytes) -> dict[str, np.ndarray]:
        return formats.read_las(data)

    @staticmethod
    def encode(points: pd.DataFrame) -> bytes:
        return formats.write_las(points[["x", "y", "z"]].to_numpy(float), points["intensity"].to_numpy(), points["cls"].to_numpy(), np.zeros((len(points), 3), int))


def register(spark: SparkSession, *sources: type[PointFiles]) -> None:
    for source in sources or (LasPoints,):
        spark.dataSource.register(source)
