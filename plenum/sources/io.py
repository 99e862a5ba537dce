"""Reading and writing tables with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def scan(
    spark: SparkSession, path: str, schema: StructType | str, columns: Sequence[str]
) -> DataFrame:
    """Read named columns of a Parquet table. The schema is given, never inferred,
    and only the listed columns reach the file scan."""
    return spark.read.schema(schema).parquet(path).select(*columns)


def seed(spark: SparkSession, rows: Sequence[tuple], schema: StructType | str) -> DataFrame:
    """A small literal relation, such as a list of states or finding types. It is
    part of the plan, so its size is known and a join with it can broadcast it."""
    shape = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    records = [dict(zip(shape.names, row, strict=True)) for row in rows]
    table = pa.Table.from_pylist(records, schema=to_arrow_schema(shape))
    return spark.createDataFrame(table, shape)


def insert_select(target: DataFrame, source: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Append the rows of a query. ``defaults`` fills target columns that the
    query does not give (as Columns); any other missing column is an error."""
    for name, value in (defaults or {}).items():
        if name not in source.columns:
            source = source.withColumn(name, value)
    typed = source.select(*[source[f.name].cast(f.dataType).alias(f.name) for f in target.schema])
    return target.unionByName(typed)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_version(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write a new version of a table next to the old one. A table is never
    overwritten while it is being read; readers switch to the new path."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
