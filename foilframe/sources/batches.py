"""Batches that can be stopped anywhere and taken up again, with running totals.

A ledger notes for each batch its range of a whole-number order, its rows and the
totals so far; it is committed together with the batch's results, so both are
there or neither. The next batch begins behind the last range that was noted,
whatever was running when the one before stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foilframe.sources.commits import Tables


class Batches:
    """One job's batches. tables: where results and ledger are kept; name: the job's, which no other has."""

    def __init__(self, tables: Tables, name: str):
        self.tables, self.name = tables, name

    def last(self) -> dict:
        """What the ledger says last: batch, first, last, rows and the totals; empty before the first batch."""
        ledger = self.tables.table(f"{self.name}_ledger")
        row = ledger.orderBy(F.desc("batch")).first() if ledger is not None else None
        return row.asDict() if row else {}

    def next(self, todo: DataFrame, order: str, size: int, process: Callable[[DataFrame], DataFrame], totals: dict[str, Column]) -> bool:
        """Takes the next size rows (0: all) of todo by order, which is unique; False if none is left.

        totals: sums over the processed rows by name, added to those of the batches before.
        """
        before = self.last()
        rest = todo.filter(F.col(order) > before["last"]) if before else todo
        if size:
            rest = rest.orderBy(order).limit(size)
        ends = rest.agg(F.min(order).alias("first"), F.max(order).alias("last")).first()
        if ends["first"] is None:
            return False
        # the range alone decides from here on, so that a batch that runs again takes the same rows
        done = process(todo.filter(F.col(order).between(ends["first"], ends["last"])))
        number = before.get("batch", 0) + 1
        sums = done.agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in totals.items()])
        noted = sums.select(
            F.lit(number).alias("batch"), F.lit(ends["first"]).cast("long").alias("first"), F.lit(ends["last"]).cast("long").alias("last"), "rows", *[(F.col(k) + F.lit(before.get(k, 0))).alias(k) for k in totals]
        )
        return self.tables.commit(f"{self.name} {number}", {f"{self.name}_results": done, f"{self.name}_ledger": noted})

    def all(self, *args) -> int:
        """next() until none is left; how many batches that took."""
        n = 0
        while self.next(*args):
            n += 1
        return n
