"""Scans, catalogue views and file sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.checks import AuditFailure, require_columns


def scan(spark: SparkSession, table: str, columns: Sequence[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """Projected, filtered read of a catalogue table; a missing table or column is an error."""
    if not spark.catalog.tableExists(table):
        raise AuditFailure(f"missing table {table}")
    df = spark.table(table)
    if columns is not None:
        require_columns(df, columns, table)
    if where is not None:
        df = df.where(where)
    return lower_names(df if columns is None else df.select(*columns))


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def optional_column(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)


def select_existing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def first_existing(candidates: Sequence[str], available: Sequence[str], required: bool = True) -> str | None:
    for c in candidates:
        if c in available:
            return c
    if required:
        raise AuditFailure("none of the expected columns exist: " + ", ".join(candidates))
    return None


def schema_inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column of every table."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(name, i + 1, f.name, f.dataType.simpleString(), f.nullable) for name, df in tables.items() for i, f in enumerate(df.schema)]
    return spark.createDataFrame(rows, "table_name string, column_position int, column_name string, column_type string, nullable boolean")


def row_counts(tables: Mapping[str, DataFrame | None], spark: SparkSession) -> DataFrame:
    """Rows per expected table; an absent table keeps its row with an unknown count."""
    parts = []
    for name, df in tables.items():
        if df is None:
            parts.append(spark.range(1).select(F.lit(name).alias("table_name"), F.lit(None).cast("long").alias("n_rows"), F.lit(False).alias("present")))
        else:
            parts.append(df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(True).alias("present")))
    return reduce(DataFrame.unionByName, parts)


def reference_matches(df: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Rows whose joined text columns match any pattern, case-insensitively."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not text:
        return df.limit(0)
    return df.where(F.concat_ws(" | ", *text).rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)))


def read_keyed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a declared schema, so that keys keep their leading zeros."""
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST")


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace an output directory; readers rely on the commit marker of the finished job."""
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if fmt == "csv" else writer.format(fmt).save(path)


def read_required(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise AuditFailure(f"required output is missing or unfinished: {path}")
    return spark.read.format(fmt).load(path)
