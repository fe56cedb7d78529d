"""Token counts: rollups maintained by deltas (operator 8).

Changes to a corpus (inserts, deletes, revised counts) become signed rows; each
batch of them is summed by source, language and tokenizer version and committed
under its number. A batch that is committed again replaces its own sums, so
replays after a failure change nothing, and totals are the sum over batches:
additive, independent of the order of commits, and never recounted. Old batches
can be folded into one, which remembers their numbers.

Null texts have no tokens; null sources and languages are groups of their own;
a revision of tokens without a change of version stays in its group. Groups whose
documents are all gone are left out of the totals. A version counts by a regular
expression or by the ids of the byte-level BPE of operator 2. Repeated rows count as often
as they are there. An empty batch is a commit without rows; without commits the
totals are empty. Columns that are not named here are not read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foilframe.llm import bpe
from foilframe.llm.staging import documents, listed, new_path, publish, read_small, removed, stage

KEYS = ["source", "lang", "tokenizer_version"]
_SUMS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"

#: How a version counts: words; or words without ASCII marks, and each such mark.
VERSIONS = {"words-1": r"[^\x20\x09-\x0D]+", "marks-2": r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"}


BPE = "byte_bpe_50k"


def count_tokens(text: Column, version: str) -> Column:
    """How many tokens a text has under one of VERSIONS."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(VERSIONS[version])).cast("long")


def counted_by_bpe(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, source, lang and n_tokens of version BPE: the ids of each whole text under a rank file."""
    return bpe.token_counts(docs, path, pattern, keep=("doc_id", "source", "lang"))


def signed(rows: DataFrame, version: Column, tokens: Column, sign: int) -> DataFrame:
    """The rows as changes: sign 1 adds a document and its tokens, -1 takes them away."""
    return rows.select("source", "lang", version.alias("tokenizer_version"), F.lit(sign).cast("long").alias("n_docs"), (tokens * sign).cast("long").alias("n_tokens"))


def revised(rows: DataFrame, old: tuple[Column, Column], new: tuple[Column, Column]) -> DataFrame:
    """The rows as changes from one (version, tokens) to another."""
    return signed(rows, *old, -1).unionByName(signed(rows, *new, 1))


class Rollup:
    """Committed batches under a path of shared storage, for one writer at a time and any readers.

    data/ has a folder for each batch as it was written, commits/ a small file for
    each batch number that names its folder, and base what was folded: a folder
    of sums and the numbers in it. A batch is written beside the others and then
    published by one rename, so readers never meet a part of it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def base(self) -> dict:
        """data: the folder of what was folded, or None; folded: ranges of batch numbers, both ends included."""
        return json.loads(read_small(self.spark, f"{self.path}/base") or '{"data": null, "folded": []}')

    def commits(self) -> dict[int, str]:
        """The folder of each published batch that isn't folded."""
        base = self.base()
        numbers = [int(x) for x in listed(self.spark, f"{self.path}/commits") if not x.startswith(".")]
        return {n: read_small(self.spark, f"{self.path}/commits/{n}") for n in numbers if not _within(n, base["folded"])}

    def _write(self, number: int, sums: DataFrame) -> str:
        name = uuid.uuid4().hex
        sums.select(*KEYS, "n_docs", "n_tokens", F.lit(number).alias("batch")).write.parquet(f"{self.path}/data/{name}")
        return name

    def commit(self, number: int, changes: DataFrame) -> None:
        """Commits the changes under a number; again under the same number replaces them, or does nothing once it is folded."""
        if _within(number, self.base()["folded"]):
            return
        sums = changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        publish(self.spark, f"{self.path}/commits/{int(number)}", self._write(int(number), sums))

    def deltas(self) -> DataFrame:
        """All committed sums, with their batch; -1 for what was folded."""
        names = [x for x in (self.base()["data"], *self.commits().values()) if x]
        if not names:
            return self.spark.createDataFrame([], f"{_SUMS}, batch int")
        return self.spark.read.schema(f"{_SUMS}, batch int").parquet(*[f"{self.path}/data/{x}" for x in names])

    def totals(self) -> DataFrame:
        sums = self.deltas().groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs != 0 OR n_tokens != 0")

    def fold(self, into: "Rollup | None" = None) -> "Rollup":
        """Makes one batch of all that is committed now, here or at another path; its numbers stay known, so replays of them change nothing."""
        into = into or self
        folded = _ranges(self.base()["folded"], self.commits())
        name = into._write(-1, self.totals())
        publish(self.spark, f"{into.path}/base", json.dumps({"data": name, "folded": folded}))
        return into

    def folded(self, path: str) -> "Rollup":
        """fold() into another path; later commits go there."""
        return self.fold(Rollup(self.spark, path))

    def clean(self) -> None:
        """Removes the folders that nothing names any more; readers that began before must be done."""
        used = {self.base()["data"], *self.commits().values()}
        for name in listed(self.spark, f"{self.path}/data"):
            if name not in used:
                removed(self.spark, f"{self.path}/data/{name}")

    def follow(self, changes: DataFrame, checkpoint: str):
        """Commits each batch of a stream of changes under the stream's own batch number."""
        return changes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, number: self.commit(number, batch)).start()


def _within(number: int, ranges: list[list[int]]) -> bool:
    return any(lo <= number <= hi for lo, hi in ranges)


def _ranges(ranges: list[list[int]], numbers) -> list[list[int]]:
    """The ranges with more numbers in them, joined where they touch."""
    out: list[list[int]] = []
    for lo, hi in sorted([*map(list, ranges), *([n, n] for n in numbers)]):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def op8_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts all documents, takes away those labelled bad, moves French and German ones to another tokenizer, replays the last commit."""
    text = F.col("text")
    counted = stage(documents(spark, sf_dir).select("doc_id", "source", "lang", count_tokens(text, "words-1").alias("old"), count_tokens(text, "marks-2").alias("new")), "rollup-counts")
    bad = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 0").select("doc_id")
    first, second = (F.lit(v) for v in VERSIONS)
    rollup = Rollup(spark, new_path(spark, "rollup"))
    rollup.commit(0, signed(counted, first, F.col("old"), 1))
    rollup.commit(1, signed(counted.join(bad, "doc_id", "left_semi"), first, F.col("old"), -1))
    moved = counted.join(bad, "doc_id", "left_anti").filter("lang IN ('fr', 'de')")
    for _ in range(2):
        rollup.commit(2, revised(moved, (first, F.col("old")), (second, F.col("new"))))
    return rollup.totals()


ORACLE = {
    "op8_token_rollups": r"""
WITH kept AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 AND doc_id IS NOT NULL)),
counted AS (
  SELECT source, lang,
    CASE WHEN lang IN ('fr', 'de') THEN 'marks-2' ELSE 'words-1' END AS tokenizer_version,
    CASE WHEN lang IN ('fr', 'de') THEN len(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]'))
         ELSE len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) END AS n
  FROM kept)
SELECT source, lang, tokenizer_version, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM counted GROUP BY ALL""",
}
