"""Sinks. All write through Spark; a run again replaces or appends as stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def overwrite_json(df: DataFrame, path: str) -> None:
    sorted_fields(df).write.mode("overwrite").json(path)


def by_class(df: DataFrame, column: str, path: str) -> None:
    """One folder for each class, classes already there replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def add_new_classes(df: DataFrame, column: str, path: str) -> None:
    """by_class() for classes that aren't there yet; those that are stay as they are."""
    files = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    if files.exists(df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)):
        df = df.join(df.sparkSession.read.parquet(path).select(F.col(column).cast(df.schema[column].dataType)).distinct(), column, "left_anti")
    df.write.mode("append").partitionBy(column).parquet(path)


def read_through(cache: DataFrame, wanted: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The cache with what was wanted, isn't in it and the source has: written as the next cache, it is read instead of the source from then on."""
    missed = wanted.select(*keys).distinct().join(cache, keys, "left_anti")
    return cache.unionByName(source.join(missed, keys, "left_semi").select(*cache.columns))


def merged_checkpoint(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new, which win where both have a key."""
    return old.join(new, key, "left_anti").select(*old.columns).unionByName(new)


def _ordered(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(column.isNotNull(), F.struct(*[_ordered(column[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(column, lambda x: _ordered(x, kind.elementType))
    return column


def sorted_fields(df: DataFrame) -> DataFrame:
    """Columns and the fields of structs in order of their names."""
    return df.select(*[_ordered(F.col(f.name), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)])


def stable_json(df: DataFrame, column: str = "json") -> DataFrame:
    """Each row as JSON with sorted keys and no white space: equal rows, equal bytes."""
    ordered = sorted_fields(df)
    return ordered.select(F.to_json(F.struct("*")).alias(column))


def safe_name(column: Column) -> Column:
    """For file names: letters, digits, _ and - only."""
    return F.regexp_replace(column, "[^\\p{Alnum}_-]", "")
