"""Rounds of connected parts send nothing through the driver."""

from foilframe.operators import patches as P


def test_no_round_broadcasts_a_table_of_runs(spark, monkeypatch):
    plans, write = [], P.written
    said = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(P, "written", lambda df, name: (plans.append(said(df)), write(df, name))[1])
    cells = [[True, False, True], [True, True, True], [False, False, False], [True, False, True]]
    rows = spark.createDataFrame([(k, y, c) for k in range(3) for y, c in enumerate(cells)], "image int, y int, cells array<boolean>")
    found = P.parts(P.runs(rows))
    plans.append(said(found))
    assert sum("Join" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)
    assert {(r.image, r.parts, r.largest) for r in P.part_sizes(found).collect()} == {(k, 3, 5) for k in range(3)}
