"""Commits over several tables: broken attempts leave nothing, attempts again count once, writers that meet both come through."""

import pytest
from pyspark.sql import functions as F

from foilframe.functions import texts as T
from foilframe.sources.commits import Tables, provision, usage_events


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_all_tables_or_none(spark, tmp_path, monkeypatch):
    tables = Tables(spark, str(tmp_path / "t"))
    one, two = spark.createDataFrame([(1, "a")], "id int, v string"), spark.createDataFrame([(1, 2.5)], "id int, x double")
    assert tables.table("one") is None and tables.commit("first", {"one": one, "two": two})
    assert not tables.commit("first", {"one": one, "two": two})

    plain = Tables._publish
    monkeypatch.setattr(Tables, "_publish", lambda self, m: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):  # broken off after both parts were written
        tables.commit("second", {"one": one, "two": two})
    monkeypatch.setattr(Tables, "_publish", plain)
    assert rows(tables.table("one")) == [(1, "a")] and rows(tables.table("two")) == [(1, 2.5)]

    broken = two.select("id", F.raise_error(F.lit("no")).cast("double").alias("x"))
    with pytest.raises(Exception, match="no"):  # broken off between the parts
        tables.commit("second", {"one": one, "two": broken})
    assert rows(tables.table("one")) == [(1, "a")]
    assert tables.commit("second", {"one": one}, {"two": two.withColumn("x", F.lit(9.0))})
    assert rows(tables.table("one")) == [(1, "a")] * 2 and rows(tables.table("two")) == [(1, 9.0)]


def test_writers_that_meet(spark, tmp_path, monkeypatch):
    first, second = Tables(spark, str(tmp_path / "t")), Tables(spark, str(tmp_path / "t"))
    df = spark.createDataFrame([(1,)], "id int")
    plain, met = Tables._publish, []

    def meeting(self, manifest):
        if self is first and not met:
            met.append(manifest["number"])
            assert second.commit("b", {"x": df})
        return plain(self, manifest)

    monkeypatch.setattr(Tables, "_publish", meeting)
    assert first.commit("a", {"x": df})
    assert met == [1] and first.manifest()["labels"] == ["b", "a"] and first.table("x").count() == 2


def test_usage_and_tenants(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "t"))
    requests = spark.createDataFrame([("k1", "/v1/analyze", 200, True)], "api_key_id string, route string, status_code long, gatekeeper_accepted boolean")
    assert tables.commit("usage-1", {"usage_events": usage_events(requests)})
    assert rows(tables.table("usage_events")) == [(None, "k1", None, "/v1/analyze", 200, True, None, None)]
    new = spark.createDataFrame([("t1", "Shop", "k1", "main", "secret")], "tenant_id string, tenant_name string, key_id string, key_name string, api_key string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    assert provision(tables, "tenant t1", new, F.lit("salt")) and not provision(tables, "tenant t1", new, F.lit("salt"))
    key = tables.table("api_keys").first()
    assert tables.table("tenants").count() == 1 and key.tenant_id == "t1" and "secret" not in str(key)
    assert key.key_hash == spark.range(1).select(T.key_hash(F.lit("salt"), F.lit("secret"))).first()[0]
