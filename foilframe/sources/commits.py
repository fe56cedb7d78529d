"""Several tables under one commit, in a folder of shared storage.

A commit writes its parts beside what is there, into folders that no one reads,
and then puts a manifest in place by one rename: readers see all tables of it or
none. Manifests are numbered, each names the parts of every table so far, and a
commit with a label that an earlier one had does nothing, so it can be tried again
after a failure at any point. Of two writers that meet, one finds the next number
taken and goes on from there. A part that no manifest names is left behind by a
broken attempt and may be removed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """The tables under a folder: parts/, and manifests/ by number."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        place, files = self._at(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
        return sorted(int(n.split(".")[0]) for n in names if n[0] != ".")

    def manifest(self) -> dict:
        """The last one: number, labels, tables (name -> parts with their schemas)."""
        numbers = self._numbers()
        if not numbers:
            return {"number": 0, "labels": [], "tables": {}}
        place, files = self._at(f"{self.path}/manifests/{numbers[-1]:09d}.json")
        stream = files.open(place)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> bool:
        """Puts a manifest in place; False if its number is taken."""
        place, files = self._at(f"{self.path}/manifests/{manifest['number']:09d}.json")
        beside, _ = self._at(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        files.mkdirs(place.getParent())
        stream = files.create(beside, True)
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        stream.close()
        jvm = self.spark._jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 0)  # a rename that overwrites nothing
        try:
            jvm.FileContext.getFileContext(files.makeQualified(beside).toUri(), self.spark._jsc.hadoopConfiguration()).rename(files.makeQualified(beside), files.makeQualified(place), none)
        except Exception as error:
            files.delete(beside, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise
        return True

    def commit(self, label: str, added: dict[str, DataFrame], replaced: dict[str, DataFrame] | None = None) -> bool:
        """Adds rows to tables and replaces others, all under one label; False if the label was committed before."""
        replaced = replaced or {}
        if label in self.manifest()["labels"]:
            return False
        parts = {}
        for name, df in (added | replaced).items():
            path = f"{self.path}/parts/{name}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            parts[name] = {"path": path, "schema": df.schema.json()}
        while True:
            now = self.manifest()
            if label in now["labels"]:
                return False
            tables = {n: list(p) for n, p in now["tables"].items()}
            for name, part in parts.items():
                tables[name] = [part] if name in replaced else [*tables.get(name, []), part]
            if self._publish({"number": now["number"] + 1, "labels": [*now["labels"], label], "tables": tables}):
                return True

    def table(self, name: str) -> DataFrame | None:
        """A table as the last manifest has it; None before its first commit."""
        parts = self.manifest()["tables"].get(name)
        if not parts:
            return None
        from pyspark.sql.types import StructType

        return self.spark.read.schema(StructType.fromJson(json.loads(parts[-1]["schema"]))).parquet(*[p["path"] for p in parts])


def usage_events(requests: DataFrame) -> DataFrame:
    """Requests as rows of usage_events; what a request doesn't say is null."""
    kinds = {"tenant_id": "string", "api_key_id": "string", "request_id": "string", "route": "string", "status_code": "int", "gatekeeper_accepted": "boolean", "reason_codes": "array<string>", "duration_ms": "int"}
    return requests.select(*[(F.col(c) if c in requests.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def provision(tables: Tables, label: str, tenants: DataFrame, salt: Column) -> bool:
    """New tenants with one key each, of which the hash alone is kept, under one commit. tenants: tenant_id, tenant_name, key_id, key_name, api_key, created_at."""
    from foilframe.functions.texts import key_hash

    keys = tenants.select(F.col("key_id").alias("id"), "tenant_id", F.col("key_name").alias("name"), key_hash(salt, F.col("api_key")).alias("key_hash"), "created_at", F.lit(None).cast("timestamp").alias("revoked_at"))
    return tables.commit(label, {"tenants": tenants.select(F.col("tenant_id").alias("id"), F.col("tenant_name").alias("name"), "created_at"), "api_keys": keys})
