"""Exact deduplication by a stateful streaming query (operator 10).

A Store is a folder of shared storage that outlives a call; documents come to it
in numbered deliveries. The stream carries a digest, a stable identifier and a
content locator for each row: the delivery, and the row's file and index in it,
whose path the delivery notes down. A streaming aggregation without watermark
keeps, for each digest, the first row with its locator and the number of rows.
Its state is keyed, never expires and lies in RocksDB on disk, checkpointed to the
store. Each batch writes the states it changed under its own batch number, so a
batch that runs again after a failure overwrites its own output; the last batch
that mentions a digest holds its final state. A delivery that is made again, as
after a restart, goes on where it stopped and is counted once.

Where a digest was seen before, the whole normalised texts are compared, those
of earlier deliveries being read again from their files; rows whose bytes differ
from those of the row kept form groups of their own, so a collision of digests
joins nothing.

Texts are equal if identical after each run of space and 0x09-0x0D is replaced
by one space; null counts as empty. Of equal texts the row of the earliest
delivery stays, and in it the one with the smallest doc_id, null ids after all
others; of rows that repeat the same id and text exactly one stays. An empty table
gives an empty result. Columns other than id and text are not read by the
operator.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from foilframe.llm.staging import PLACE, ROW_BITS, as_files, documents, file_paths, listed, local_table, moved, new_path, numbered, stage, text_or_empty

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: RocksDB would set aside megabytes of disk for the log of each of many small stores.
_STATE = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def normalised(text: Column) -> Column:
    """Each run of white space as one space. Single spaces, the usual case, aren't touched."""
    return F.regexp_replace(text, "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def keyed(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, digest of the normalised text, and the row's place in this table, which tells repeated rows apart."""
    return numbered(docs).select(
        "doc_id",
        digest(normalised(text_or_empty())).alias("digest"),
        F.col(PLACE).alias("place"),
    )


def _first() -> Column:
    """What is kept of the rows of a digest: the least of these. unnamed: whether it has no id."""
    return F.struct("delivery", F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("doc_id"), F.col("place").alias("place"))


class Store:
    """The folder of one stream of deliveries: keys/ by delivery, each put there by one rename, query/ with the state, states/ by batch, files/ with paths by delivery."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def take_in(self, docs: DataFrame, paths: list[str], number: int, digest: Callable[[Column], Column] = sha256) -> DataFrame:
        """The keys of a delivery, written on its first call; docs: numbered rows of the files at paths."""
        path = f"{self.path}/keys/delivery={int(number)}"
        if "_SUCCESS" not in listed(self.spark, path):
            local_table(self.spark, [(p, k) for k, p in enumerate(paths)], "path string, file long").write.mode("overwrite").parquet(f"{self.path}/files/delivery={int(number)}")
            beside = f"{self.path}/incoming/{uuid.uuid4().hex}"  # the stream must not meet files of a write that breaks off
            keyed(docs, digest).write.parquet(beside)
            moved(self.spark, beside, path)
        return self.spark.read.schema(_ddl(keyed(docs, digest))).parquet(path).withColumn("delivery", F.lit(int(number)))

    def run(self, max_files_per_batch: int | None = None) -> None:
        """Brings the state up to all deliveries taken in. The state lives in RocksDB; the settings are put back afterwards."""
        spark, out = self.spark, f"{self.path}/states"
        first = listed(spark, f"{self.path}/keys")[0]
        schema = spark.read.parquet(f"{self.path}/keys/{first}").schema.add("delivery", IntegerType())
        reader = spark.readStream.schema(schema)
        if max_files_per_batch:
            reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
        states = reader.parquet(f"{self.path}/keys").groupBy("digest").agg(F.min(_first()).alias("keep"), F.count(F.lit(1)).alias("group_size"))

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        before = {k: spark.conf.get(k, None) for k in _STATE}
        for k, v in _STATE.items():
            spark.conf.set(k, v)
        try:
            query = states.writeStream.outputMode("update").option("checkpointLocation", f"{self.path}/query").trigger(availableNow=True).foreachBatch(write).start()
            query.awaitTermination()
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    def batches(self) -> list[str]:
        """The folders of the batches that were written, from storage."""
        every = [f"{self.path}/states/{x}" for x in listed(self.spark, f"{self.path}/states") if x.startswith("batch=")]
        return [x for x in every if "_SUCCESS" in listed(self.spark, x)]

    def states(self) -> DataFrame:
        """digest, keep, group_size: the last state of each digest."""
        found = self.batches()
        every = self.spark.read.option("basePath", f"{self.path}/states").parquet(*found)
        if len(found) == 1:
            return every.drop("batch")
        return every.groupBy("digest").agg(F.max_by(F.struct("keep", "group_size"), "batch").alias("s")).select("digest", "s.keep", "s.group_size")

    def earlier_texts(self, wanted: DataFrame) -> DataFrame:
        """delivery, place and normalised text of the wanted rows (delivery, place) of earlier deliveries, from the files that hold any."""
        files = self.spark.read.option("basePath", f"{self.path}/files").parquet(f"{self.path}/files")
        held = wanted.select("delivery", F.shiftright("place", ROW_BITS).alias("file")).distinct().join(files, ["delivery", "file"]).collect()  # one row for each such file
        out = None
        for delivery in sorted({r["delivery"] for r in held}):
            paths = {r["path"]: r["file"] for r in held if r["delivery"] == delivery}
            rows = numbered(self.spark.read.parquet(*[unquote(p) for p in paths]), paths)
            own = rows.join(wanted.filter(F.col("delivery") == delivery).select(F.col("place").alias(PLACE)), PLACE).select(F.lit(delivery).alias("delivery"), F.col(PLACE).alias("place"), normalised(text_or_empty()).alias("text"))
            out = own if out is None else out.unionByName(own)
        return wanted.select("delivery", "place", F.lit("").alias("text")).limit(0) if out is None else out


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def deliver(store: Store, docs: DataFrame, number: int = 0, digest: Callable[[Column], Column] = sha256, max_files_per_batch: int | None = None) -> DataFrame:
    """One row per row of a delivery: doc_id, place, keep_id, keep_place, keep_delivery, group_size, kept, digest.

    place numbers the rows of docs as numbered() does; keep_id, keep_place and
    keep_delivery are those of the row that stays, group_size counts it and its
    copies in all deliveries so far.
    """
    files = as_files(docs)
    paths, docs = file_paths(files), numbered(files)
    rows = store.take_in(docs, paths, number, digest)
    store.run(max_files_per_batch)
    states = store.states()
    if number:  # of a later delivery, the states that it touches
        states = states.join(rows.select("digest").distinct(), "digest", "left_semi")
    if number or len(store.batches()) > 1:  # else they are a written table as they are
        states = stage(states, "dedup-states")

    # a group of one needs no comparison; of larger ones every row is held against the row kept
    shared = states.filter("group_size > 1")
    texts = docs.select(F.col(PLACE).alias("place"), normalised(text_or_empty()).alias("text"))
    kept_texts = texts.join(shared.filter(F.col("keep.delivery") == number).select(F.col("keep.place").alias("place"), "digest"), "place").select("digest", F.col("text").alias("kept_text"))
    if number:
        old = stage(shared.filter(F.col("keep.delivery") != number).select("digest", "keep.delivery", "keep.place"), "dedup-old")
        kept_texts = kept_texts.unionByName(store.earlier_texts(old.drop("digest")).join(old, ["delivery", "place"]).select("digest", F.col("text").alias("kept_text")))
    seen = texts.join(rows.join(shared.select("digest"), "digest").select("place", "digest", "doc_id", "delivery"), "place")
    compared = stage(
        seen.join(kept_texts, "digest").select("place", "digest", "doc_id", "delivery", (F.col("text") == F.col("kept_text")).alias("same"), F.when(F.col("text") != F.col("kept_text"), F.col("text")).alias("other")),
        "dedup-compared",
    )
    others = compared.filter("not same")
    if others.isEmpty():
        final = rows.join(states, "digest")
    else:  # digests collided: the text itself is the key of those rows
        own = others.groupBy("digest", "other").agg(F.min(_first()).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        apart = others.join(own, ["digest", "other"]).select("place", F.col("keep").alias("own_keep"), F.col("group_size").alias("own_size"))
        gone = others.groupBy("digest").agg(F.count(F.lit(1)).alias("gone"))
        final = (
            rows.join(states, "digest").join(gone, "digest", "left").join(apart, "place", "left")
            .withColumn("keep", F.coalesce("own_keep", "keep"))
            .withColumn("group_size", F.coalesce("own_size", F.col("group_size") - F.coalesce("gone", F.lit(0))))
        )
    kept = (F.col("place") == F.col("keep.place")) & (F.col("keep.delivery") == number)
    return final.select("doc_id", "place", F.col("keep.doc_id").alias("keep_id"), F.col("keep.place").alias("keep_place"), F.col("keep.delivery").alias("keep_delivery"), "group_size", kept.alias("kept"), "digest")


def dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, max_files_per_batch: int | None = None) -> DataFrame:
    """deliver() of one delivery to a store of its own."""
    return deliver(Store(docs.sparkSession, new_path(docs.sparkSession, "dedup")), docs, 0, digest, max_files_per_batch)


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    files = as_files(docs)
    docs = numbered(files)
    stay = dedup(files).filter("kept").select(F.col("place").alias(PLACE))
    return docs.join(stay, PLACE, "left_semi").drop(PLACE)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLE = {
    "op10_exact_dedup": r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)""",
}
