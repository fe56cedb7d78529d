"""Exact dedup over several deliveries, with restarts in between and digests that collide."""

import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from foilframe.llm import exact_dedup


def write(path, rows, files=2):
    path.mkdir()
    for k in range(files):
        part = rows[k::files]
        pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in part], pa.int64()), "text": pa.array([t for _, t in part], pa.string()), "place": ["clash"] * len(part)}), path / f"{k} é%.parquet")


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def decisions(df):
    return sorted(((r.doc_id, r.keep_delivery, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=str)


def plain(deliveries):
    """Each delivery's decisions, the earlier ones known."""
    out, first, count = [], {}, {}
    for number, rows in enumerate(deliveries):
        for i, t in rows:
            count[norm(t)] = count.get(norm(t), 0) + 1
        for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
            first.setdefault(norm(t), (number, i))
        seen, own = set(), []
        for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
            k = norm(t)
            kept = first[k] == (number, i) and k not in seen
            seen.add(k) if kept else None
            own.append((i, *first[k], count[k], kept))
        out.append(sorted(own, key=str))
    return out


DELIVERIES = [
    [(5, "a b"), (3, "a  b"), (9, "c"), (4, None), (None, "d"), (7, "e")],
    [(1, "a\tb"), (12, "f"), (2, ""), (11, "f"), (None, "d"), (13, "g " * 5000)],
    [(20, "g " * 5000), (21, "c"), (22, "h")],
]


@pytest.mark.parametrize("weak", [False, True])
def test_state_outlives_a_call(spark, tmp_path, weak):
    digest = (lambda t: F.lit("same")) if weak else exact_dedup.sha256
    want = plain(DELIVERIES)
    for number, rows in enumerate(DELIVERIES):
        write(tmp_path / f"day{number}", rows)
        store = exact_dedup.Store(spark, str(tmp_path / "store"))  # a new object each time, as after a restart
        got = decisions(exact_dedup.deliver(store, spark.read.parquet(str(tmp_path / f"day{number}")), number, digest))
        if not weak:
            assert got == want[number]
        elif number == 0:  # one digest: only the bytes tell texts apart
            assert got == want[0]
        again = decisions(exact_dedup.deliver(store, spark.read.parquet(str(tmp_path / f"day{number}")), number, digest))
        assert again == got  # made again, counted once


def test_restart_between_keys_and_state(spark, tmp_path, monkeypatch):
    for number, rows in enumerate(DELIVERIES[:2]):
        write(tmp_path / f"day{number}", rows)
    docs = [spark.read.parquet(str(tmp_path / f"day{k}")) for k in range(2)]
    store = exact_dedup.Store(spark, str(tmp_path / "store"))
    exact_dedup.deliver(store, docs[0], 0)

    def crash(*_):
        raise OSError

    monkeypatch.setattr(exact_dedup.Store, "run", crash)
    with pytest.raises(OSError):
        exact_dedup.deliver(store, docs[1], 1)
    monkeypatch.undo()
    store = exact_dedup.Store(spark, str(tmp_path / "store"))
    assert decisions(exact_dedup.deliver(store, docs[1], 1, max_files_per_batch=1)) == plain(DELIVERIES[:2])[1]
    assert len(store.states().collect()) == len({norm(t) for d in DELIVERIES[:2] for _, t in d})


def test_an_empty_delivery(spark, tmp_path):
    write(tmp_path / "day", [], 1)
    store = exact_dedup.Store(spark, str(tmp_path / "store"))
    assert exact_dedup.deliver(store, spark.read.parquet(str(tmp_path / "day")), 0).count() == 0
    write(tmp_path / "next", DELIVERIES[0])
    assert len(decisions(exact_dedup.deliver(store, spark.read.parquet(str(tmp_path / "next")), 1))) == 6
