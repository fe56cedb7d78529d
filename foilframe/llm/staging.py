"""Written tables in the folder that the cluster shares, used to cut lineage.

Every table goes to ``spark.checkpoint.dir``; a lost executor never takes a
written part with it. Only where that setting is missing, as in tests, a
temporary folder is made and set; a session that isn't local must name it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    if not found:
        found = tempfile.mkdtemp(prefix="spark-foilframe-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_made: list[list[str]] = []  # the folders of each scratch() that is open, outermost first


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of the shared storage that no one else has."""
    path = f"{shared_dir(spark)}/foilframe/{name}-{uuid.uuid4().hex}"
    for made in _made[-1:]:
        made.append(path)
    return path


@contextmanager
def text_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Inside, Arrow batches have at most so many rows, for tables of texts, whose batches would take tens of megabytes else."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, rows)
        yield
    finally:
        spark.conf.set(name, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: computed once, read from shared storage afterwards."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that new_path() names inside are removed at the end; what is made of them must be written by then."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            removed(spark, path)


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def removed(spark: SparkSession, path: str) -> None:
    place, files = _at(spark, path)
    files.delete(place, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of the shared storage; none where there is no such folder."""
    place, files = _at(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def moved(spark: SparkSession, path: str, to: str) -> None:
    """Puts a written folder in place by one rename; what an earlier attempt left there goes."""
    old, files = _at(spark, path)
    new, _ = _at(spark, to)
    files.mkdirs(new.getParent())
    files.delete(new, True)
    if not files.rename(old, new):
        raise OSError(f"{path} can't be moved to {to}")


def read_small(spark: SparkSession, path: str) -> str | None:
    """A small text file of the shared storage, or None where there is none."""
    place, files = _at(spark, path)
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Puts a small text file in place by one rename: readers meet the old one or the new one, whole."""
    place, files = _at(spark, path)
    beside, _ = _at(spark, f"{place.getParent().toString()}/.{uuid.uuid4().hex}")
    stream = files.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    how = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(how, 1)
    over[0] = how.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.makeQualified(beside).toUri(), conf).rename(files.makeQualified(beside), files.makeQualified(place), over)


_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}


def local_table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A few rows of the driver as a frame, sent as Arrow, for which no Python worker is started. columns: name type, ..."""
    fields = [f.split() for f in columns.split(", ")]
    return spark.createDataFrame(pa.table({name: pa.array([r[k] for r in rows], _ARROW[kind]) for k, (name, kind) in enumerate(fields)}))


#: Rows up to which a written table of a few numbers is sent to every task; beyond it is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, of a few numbers in each row, with a broadcast hint if it has at most limit rows, which are counted first."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text"):
    """A null text counts as an empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def free(name: str, columns: list[str]) -> str:
    """name, or one made of it that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: The column of row numbers; made anew for each driver, so that no table has it already.
PLACE = f"__row_place_{uuid.uuid4().hex}"
ROW_BITS = 40


def as_files(docs: DataFrame) -> DataFrame:
    """docs if it is a plain scan of Parquet files, else written as such."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    return docs if plan.nodeName() == "LogicalRelation" and plan.relation().toString() == "parquet" else stage(docs, "documents")


def file_paths(docs: DataFrame) -> list[str]:
    """The paths of the files behind docs, sorted: one for each file."""
    return sorted(r[0] for r in docs.select(docs.metadataColumn("_metadata")["file_path"]).distinct().collect())


def numbered(docs: DataFrame, numbers: dict[str, int] | None = None) -> DataFrame:
    """docs with PLACE, a number for each row that every scan gives it, however the files are split; anything but Parquet files is written first.

    Splits depend on the cores that are registered, so numbers of partitions
    won't do: the place is the file's number, by the sorted paths unless numbers
    are given, and the row's index in it.
    """
    if PLACE in docs.columns:
        return docs
    docs = as_files(docs)
    meta = docs.metadataColumn("_metadata")
    numbers = numbers or {p: k for k, p in enumerate(file_paths(docs))}
    path, number = free("__file", docs.columns), free("__file_number", docs.columns)
    files = local_table(docs.sparkSession, list(numbers.items()), f"{path} string, {number} long")  # one row for each file
    placed = docs.withColumns({path: meta["file_path"], PLACE: meta["row_index"]}).join(F.broadcast(files) if len(numbers) <= BROADCAST_ROWS else files, path)
    return placed.withColumn(PLACE, F.shiftleft(number, ROW_BITS) + F.col(PLACE)).select(*docs.columns, PLACE)
