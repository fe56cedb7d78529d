"""The sweep of 81 probes against plain Python."""

import re

import pytest

from foilframe.operators import relational as R
from foilframe.plans import catalog

D = "/root/testdata/sf0.001"
EVERY = [(c, a, m) for c in R.CROPS for a in range(-12, 13, 3) for m in (7, 8, 13)]


def plain(texts):
    best, top = (None,) * 6, -1e9
    for (crop, angle, mode), text in zip(EVERY, texts):
        m = re.search(r"(\d{1,3})\s*/\s*(\d{1,3})", text or "")
        if not m:
            continue
        n, t = map(int, m.groups())
        score = 2.0 * (20 <= t <= 500) + (t >= 50) + 0.5 * (n > 0) - 5 * (n > t + 150) - 0.05 * abs(angle)
        if score > top:
            best, top = (f"{n}/{t}", crop, angle, mode, text.strip(), round(max(0.5, min(0.9, 0.5 + score / 5)), 6)), score
    return best


def test_every_probe_is_tried(spark):
    got = R.probes(spark.range(2)).collect()
    assert sorted((r.id, r.probe, r.crop, r.angle, r.mode) for r in got) == [(i, k, *x) for i in range(2) for k, x in enumerate(EVERY)]


def test_best_of_the_sweep(spark):
    rows = {r.p_partkey: tuple(r)[1:] for r in catalog.QUERIES["vintage_sweep"](spark, D).collect()}
    keys = [r.p_partkey for r in spark.read.parquet(f"{D}/part.parquet").collect()]
    assert sorted(rows) == sorted(keys)
    for p in keys:
        texts = []
        for probe in range(81):
            s = p * 31 + probe * 17
            texts.append("" if p % 9 == 0 else f"{s % 700} / {s % 613}" if s % 3 == 0 else f"{s % 99}/" if s % 3 == 1 else None)
        want = plain(texts)
        assert rows[p][:5] == want[:5]
        assert rows[p][5] == (want[5] and pytest.approx(want[5], abs=1e-6))
    assert any(r[0] is None for r in rows.values())
