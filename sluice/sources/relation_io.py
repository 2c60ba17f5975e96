"""Relation files: a 16-byte header (rows, columns), then one array of little-endian 64-bit values per column.

Also the text forms: rows with a bar after each value, and the statements that create and load a table.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StructField, StructType

#: Rows of one read task.
SPLIT = 1 << 21


def _local(path: str) -> str:
    return re.sub("^file:(//)?", "", path)


def header(path: str) -> tuple[int, int]:
    size = os.path.getsize(path)
    if size < 16:
        raise ValueError(f"{path} holds no header")
    rows, columns = np.fromfile(path, "<u8", 2).tolist()
    if size != 16 + 8 * rows * columns:
        raise ValueError(f"{path} has {size} bytes; its header says {rows} rows of {columns}")
    return rows, columns


class _Rows(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class RelationReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.rows, self.columns = header(path)

    def partitions(self):
        return [_Rows(a, min(self.rows, a + SPLIT)) for a in range(0, self.rows, SPLIT)] or [_Rows(0, 0)]

    def read(self, partition):
        import pyarrow as pa

        names = [f"c{i}" for i in range(self.columns)]
        for a in range(partition.start, partition.stop, 1 << 16):
            n = min(1 << 16, partition.stop - a)
            yield pa.RecordBatch.from_arrays([pa.array(np.fromfile(self.path, "<i8", n, offset=16 + 8 * (i * self.rows + a))) for i in range(self.columns)], names)


class RelationSource(DataSource):
    """``spark.read.format("relation").load(path)``; the path must be readable on each executor."""

    @classmethod
    def name(cls) -> str:
        return "relation"

    def schema(self) -> StructType:
        _, columns = header(_local(self.options["path"]))
        return StructType([StructField(f"c{i}", LongType(), False) for i in range(columns)])

    def reader(self, schema) -> DataSourceReader:
        return RelationReader(_local(self.options["path"]))


def read_relation(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(RelationSource)
    return spark.read.format("relation").load(path)


def to_parquet(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Converts once; later reads prune columns and skip row groups."""
    read_relation(spark, path).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def write_relation(df: DataFrame, path: str) -> None:
    """Writes the file: each task streams its columns to segments beside it, which the driver then joins as they are.

    The folder must be one that the tasks and the driver share.  A null is an error.
    """
    columns, path = len(df.columns), _local(path)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    folder = f"{path}.{uuid.uuid4().hex}"
    os.makedirs(folder)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        name, rows = f"{folder}/{uuid.uuid4().hex}", 0
        out = [open(f"{name}.{i}", "wb") for i in range(columns)]
        for batch in batches:
            rows += batch.num_rows
            for f, column in zip(out, batch.columns):
                if column.null_count:
                    raise ValueError("a relation holds no nulls")
                f.write(column.to_numpy().astype("<i8", copy=False).tobytes())
        for f in out:
            f.close()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]), pa.array([rows], pa.int64())], ["part", "name", "n"])

    try:
        longs = df.select(*[F.col(f"`{c}`").cast("long").alias(f"c{i}") for i, c in enumerate(df.columns)])
        parts = sorted(longs.mapInArrow(run, "part int, name string, n long").collect()) if columns else []  # a row for each task
        with open(f"{folder}/whole", "wb") as f:
            f.write(np.array([sum(x.n for x in parts) if columns else df.count(), columns], "<u8").tobytes())
            for i in range(columns):
                for x in parts:
                    with open(f"{x.name}.{i}", "rb") as segment:
                        shutil.copyfileobj(segment, f, 1 << 22)
        os.replace(f"{folder}/whole", path)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def generated(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    """Every column of row i is i."""
    return spark.range(rows).select(*[F.col("id").alias(f"c{i}") for i in range(columns)])


def bar_lines(df: DataFrame) -> DataFrame:
    """A column ``value``: each value followed by a bar."""
    return df.select(F.concat(F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns]), F.lit("|")).alias("value"))


def write_bar_lines(df: DataFrame, path: str) -> None:
    bar_lines(df).write.mode("overwrite").text(path)


def table_statements(df: DataFrame, number: int) -> str:
    columns = ",".join(f"c{i} bigint" for i in range(len(df.columns)))
    return f"CREATE TABLE r{number} ({columns});\ncopy r{number} from 'r{number}.tbl' delimiter '|';\n"


def store_all(df: DataFrame, folder: str, number: int) -> str:
    """The binary file r<n>, the rows r<n>.tbl and the statements r<n>.sql; returns the base name."""
    base = f"r{number}"
    write_relation(df, f"{folder}/{base}")
    write_bar_lines(df, f"{folder}/{base}.tbl")
    with open(f"{_local(folder)}/{base}.sql", "w") as f:
        f.write(table_statements(df, number))
    return base
