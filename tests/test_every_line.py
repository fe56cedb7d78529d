"""Every line is looked up, not a slice of them."""

from collections import Counter, defaultdict

import pyarrow.parquet as pq

from foilframe.plans import catalog

D = "/root/testdata/sf0.001"


def test_every_line_gets_its_sets(spark):
    official, total = defaultdict(list), defaultdict(list)
    for p in pq.read_table(f"{D}/part.parquet")["p_partkey"].to_pylist():
        official[p // 2 * 4].append(p)
        total[p // 2 * 4 + (4 if p % 2 else 1)].append(p)
    lines = pq.read_table(f"{D}/lineitem.parquet").select(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    want = Counter()
    for o, n, p, s in zip(*(x.to_pylist() for x in lines)):
        w = 2 * p + n % 2
        for tier, sets in ((1, official), (2, total)):
            if w in sets:
                want.update((o, n, p, s, x, tier) for x in sets[w])
                break
    got = Counter(map(tuple, catalog.QUERIES["set_lookup_every_line"](spark, D).collect()))
    assert got == want and {k[5] for k in want} == {1, 2} and len({k[1] for k in want}) > 1
