"""Relations by number.  A relation is a DataFrame of longs c0, c1, ...; its rows are read only when a query runs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Catalog:
    frames: list[DataFrame] = field(default_factory=list)
    #: Numbers of relations whose values may have the top bit; their comparisons are unsigned.
    wide: set[int] = field(default_factory=set)

    def add(self, df: DataFrame, wide: bool = False) -> int:
        number = len(self.frames)
        self.frames.append(df.select(*[F.col(c).cast("long").alias(f"c{i}") for i, c in enumerate(df.columns)]))
        if wide:
            self.wide.add(number)
        return number

    def __getitem__(self, number: int) -> DataFrame:
        if not 0 <= number < len(self.frames):
            raise ValueError(f"there is no relation {number}")
        return self.frames[number]

    def register_views(self) -> None:
        for i, df in enumerate(self.frames):
            df.createOrReplaceTempView(f"r{i}")


#: The integer columns of the shared test tables, by relation number.
TABLES = [
    ("region", ["r_regionkey"]),
    ("nation", ["n_nationkey", "n_regionkey"]),
    ("customer", ["c_custkey", "c_nationkey"]),
    ("supplier", ["s_suppkey", "s_nationkey"]),
    ("part", ["p_partkey", "p_size"]),
    ("orders", ["o_orderkey", "o_custkey"]),
    ("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]),
    ("events", ["event_id", "user_id"]),
]


def table_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    out = Catalog()
    for name, columns in TABLES:
        out.add(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns))
    return out
