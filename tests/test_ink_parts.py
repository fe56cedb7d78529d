"""Orders are dealt out by the count of their lines, in one shuffle."""

import pytest

from foilframe.plans import catalog, reports

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", ["ink_islands", "wide_box_split"])
def test_more_lines_are_more_parts(spark, query, monkeypatch):
    whole = sorted(map(tuple, catalog.QUERIES[query](spark, D).collect()))
    lines = spark.read.parquet(f"{D}/lineitem.parquet").count()
    monkeypatch.setattr(reports, "INK_ROWS", -(-lines // 40), raising=False)
    dealt = catalog.QUERIES[query](spark, D)
    assert dealt.rdd.getNumPartitions() == 40
    assert sorted(map(tuple, dealt.collect())) == whole
