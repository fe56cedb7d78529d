"""Shards, mixes, joins, rollups, classifier, dedup and the pipeline: against plain Python."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foilframe.llm import components, exact_dedup, mixing, ngram_join, quality, registry, sharding, token_rollups
from foilframe.llm.staging import stage

D = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, place string, kept string"


def frame(spark, rows):
    return stage(spark.createDataFrame([(i, t, "en", s, len(t or ""), "clash", "clash") for i, t, s in rows], DOCS), "test")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and repeated rows, ties."""
    rows = [(1, "a b c d e f g", "s"), (2, "a  b c d\te f g", "s"), (3, None, None), (4, "", "s"), (5, "  \n ", "t"), (None, "a b c d e f g", "s"), (1, "a b c d e f g", "s"), (6, "x y", "t"), (7, "X\ny", None)]
    return frame(spark, rows)


def test_exact_dedup_states_and_ties(spark, odd):
    rows = exact_dedup.dedup(odd).collect()
    assert len(rows) == 9
    groups = {}
    for r in odd.collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), []).append(r.doc_id)
    for r in rows:
        members = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.digest)
        assert r.group_size == len(members) and r.keep_id == min(i for i in members if i is not None)
    assert sum(r.kept for r in rows) == len(groups)
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)
    assert exact_dedup.dedup(odd.limit(0)).count() == 0


def test_dedup_in_batches_and_with_collisions(spark, odd):
    many = stage(odd.repartition(4), "test")
    want = sorted((r.doc_id or -1, r.keep_id, r.group_size) for r in exact_dedup.dedup(many).collect())
    assert want == sorted((r.doc_id or -1, r.keep_id, r.group_size) for r in exact_dedup.dedup(many, max_files_per_batch=1).collect())
    weak = exact_dedup.dedup(many, digest=lambda t: F.lit("same"))
    got = weak.collect()
    assert want == sorted((r.doc_id or -1, r.keep_id, r.group_size) for r in got) and sum(r.kept for r in got) == 5


def test_vector_shards(spark, odd):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdef") * rng.randint(1, 9) for _ in range(rng.randint(0, 60))), "s") for i in range(400)] + [(1000 + i, "hot copy of a text", "s") for i in range(250)]
    got = sharding.assign(frame(spark, rows), 8).collect()
    assert len(got) == 650
    load = np.zeros(8)
    for r in got:
        load[r.shard] += r["size"]
    assert load.max() / load.mean() < 1.03 and load.min() / load.mean() > 0.97
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.assign(frame(spark, rows), 8).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}
    small = sharding.assign(odd, 8).collect()
    assert len(small) == 9 and {r["size"] for r in small if r.doc_id in (3, 4)} == {1}
    assert sharding.assign(odd.limit(0), 8).count() == 0


def test_equal_texts_share_a_shard(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdef") * rng.randint(1, 9) for _ in range(rng.randint(1, 60))) for _ in range(4000)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(5000 + i, "one text that stands sixty times " * 9, "s") for i in range(60)] + [(6000 + i, "x", "s") for i in range(1500)]
    rows += [(20000, None, "s"), (20001, "", "s"), (20002, None, "s")]
    text = {i: t or "" for i, t, _ in rows}
    got = sharding.assign(frame(spark, rows), 8).collect()
    where, load = {}, np.zeros(8)
    for r in got:
        where.setdefault(text[r.doc_id], set()).add(r.shard)
        load[r.shard] += r["size"]
    assert len(got) == len(rows) and all(len(w) == 1 for w in where.values()) and load.max() / load.min() < 1.03
    huge = rows + [(8000 + i, "a text too large for any one shard " * 20, "s") for i in range(3000)]  # most of all bytes
    got = sharding.assign(frame(spark, huge), 8).collect()
    load = np.bincount([r.shard for r in got], [r["size"] for r in got], 8)
    apart = {r.shard for r in got if 8000 <= r.doc_id < 20000}
    share = sum(r["size"] for r in got if 8000 <= r.doc_id < 20000) / load.mean()
    assert load.max() / load.min() < 1.03 and 1 < share <= len(apart)
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got))) for k in range(8))


def test_packing_against_every_placement():
    rng = np.random.default_rng(8)
    worst = []
    for _ in range(40):
        units = rng.integers(1, 30, (7, 3)).astype(float)
        share = units / (units.sum(axis=0) / 2)

        def most(where):
            return max(share[np.array(where) == k].sum(axis=0).max(initial=0) for k in range(2))

        best = min(most([n >> k & 1 for k in range(7)]) for n in range(1 << 7))
        worst.append(most(sharding.pack(units, 2)) - best)
    assert np.mean(worst) < 0.2 and max(worst) < 0.5  # of a shard, with units of two sevenths of one
    even = sharding.pack(np.ones((64, 3)), 8)
    assert np.bincount(even).tolist() == [8] * 8 and sharding.pack(np.zeros((0, 3)), 4).tolist() == []


def plain_targets(sizes):
    """Weights 1, 2, 3 by turns; what is above three times a size is shared again, in fractions."""
    from fractions import Fraction

    target, open_, left = {}, list(range(len(sizes))), Fraction(sum(sizes))
    while open_:
        weight = sum(i % 3 + 1 for i in open_)
        over = [i for i in open_ if left * (i % 3 + 1) / weight > 3 * sizes[i]]
        if not over:
            target.update({i: left * (i % 3 + 1) / weight for i in open_})
            break
        for i in over:
            target[i] = Fraction(3 * sizes[i])
        left -= sum(target[i] for i in over)
        open_ = [i for i in open_ if i not in over]
    return [float(target[i]) for i in range(len(sizes))]


def test_mixing_targets(spark):
    rng = random.Random(9)
    for sizes in ([100, 100, 100], [1000, 10, 10], [0, 0], [5], [0, 7, 0, 1, 900], [rng.randint(0, 50) ** 3 for _ in range(60)]):
        names = sorted(rng.sample([f"s{k}é" if k % 2 else f"S{k}" for k in range(100)], len(sizes) - 1)) + [None]
        df = stage(spark.createDataFrame(list(zip(names, sizes)), "source string, size long").repartition(3), "test")
        got = sorted(mixing.targets(mixing.ranked(df)).collect(), key=lambda r: r.k)
        assert [r.source for r in got] == names and [r.k for r in got] == list(range(len(sizes)))
        assert [r.target for r in got] == pytest.approx(plain_targets(sizes))
    assert mixing.targets(mixing.ranked(df.limit(0))).count() == 0


def test_thresholds_against_sorting(spark):
    """The cut takes the rows with the smallest hashes up to the one at which the budget runs out."""
    rng = random.Random(2)
    rows = [(k, rng.getrandbits(60), rng.randint(0, 9)) for k in range(4) for _ in range(400)] + [(4, 77, 5)] * 30 + [(5, (1 << 50) + j, 1) for j in range(50)]
    goals = [(0, 0.0), (1, 500.5), (2, 1e9), (3, 1.0), (4, 80.0), (5, 20.5)]
    cuts = {r.k: r.cut for r in mixing.thresholds(spark.createDataFrame(rows, "k long, h long, size long"), spark.createDataFrame(goals, "k long, budget double")).collect()}
    assert sorted(cuts) == [k for k, _ in goals]
    for k, budget in goals:
        own = sorted((h, n) for x, h, n in rows if x == k)
        taken = sum(n for h, n in own if h < cuts[k])
        if k == 4:
            assert taken == 150  # one hash: all or nothing, whichever is nearer
        elif budget >= sum(n for _, n in own):
            assert taken == sum(n for _, n in own)
        else:
            assert abs(taken - budget) <= 9 and (budget > 0 or taken == 0)
    nested = [{r.k: r.cut for r in mixing.thresholds(spark.createDataFrame(rows, "k long, h long, size long"), spark.createDataFrame([(1, b)], "k long, budget double")).collect()}[1] for b in (100.0, 400.0, 900.0)]
    assert nested == sorted(nested)


def test_source_mix(spark, odd):
    rng = random.Random(7)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "a", "a", "b", "c", None, "é"])) for i in range(600)]
    docs = frame(spark, rows).withColumns({"times": F.lit("clash"), "copy": F.lit("clash"), "COUNT": F.lit(1)})
    got = mixing.mix(docs).collect()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(t.split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, plain_targets([size[s] for s in order])))
    assert len(got) == 600
    for s in order:
        own = [r for r in got if r.source == s]
        assert own[0].source_size == size[s] and abs(own[0].target - want[s]) < 1e-6
        assert abs(sum(r.taken for r in own) - want[s]) <= 40
    assert all(r.taken <= 3 * r["size"] for r in got)
    again = mixing.mix(docs.repartition(3)).drop("place")
    key = lambda r: str(tuple(r))
    assert sorted((r.doc_id, r.source, r["size"], r.taken, r.times) for r in again.collect() if r.source) == sorted((r.doc_id, r.source, r["size"], r.taken, r.times) for r in got if r.source)
    assert sorted(again.collect(), key=key) == sorted(mixing.mix(docs).drop("place").collect(), key=key)
    copies = mixing.mixed(docs)
    assert copies.count() == sum(r.times for r in got) and copies.columns == docs.columns
    assert mixing.mix(odd).count() == 9 and mixing.mix(odd.limit(0)).count() == 0 and mixing.mixed(odd).columns == odd.columns
    assert {r.taken for r in mixing.mix(frame(spark, [(1, None, "a"), (2, "", "b")])).collect()} == {0}


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            o = len(sets[i] & sets[j])
            if i < j and sets[i] and 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_ngram_join_equals_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 120))] for _ in range(40)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, "ONE  two"), (4, "a b c d")]
    for k in range(320):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.4:
            words[rng.randrange(len(words)) :] = passage
        rows.append((10 + k, rng.choice([" ", "\n"]).join(words)))
    want = brute_components(rows)
    docs = frame(spark, [(i, t, "s") for i, t in rows])
    for slots, most in ((1 << 16, 3), (1 << 17, 2000)):  # the first with lists that turn out long after all
        monkeypatch.setattr(components, "LEAST", most * 10)  # and with lists that are split
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_components(docs, slots=slots, most=most).collect()}
        assert got == want
    kept = ngram_join.representatives(docs, slots=1 << 16)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()}) and kept.columns == docs.columns


def test_ngram_join_odd_rows(spark, odd):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similarity_components(odd, slots=1 << 16).collect()]
    assert sorted(got, key=str) == sorted([(1, 3, 1), (2, 3, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (None, 3, 1), (1, 3, 1), (6, 1, 6), (7, 1, 6)], key=str)
    assert ngram_join.similarity_components(odd.limit(0), slots=1 << 16).count() == 0
    assert ngram_join.representatives(odd, slots=1 << 16).count() == 5


def test_parity_bounds_differences(spark):
    rng = np.random.default_rng(2)
    rows = []
    for n, m in ((10, 12), (500, 600), (500, 520), (100, 130), (100, 101), (130, 120), (64, 66)):
        for part in (0, 0.02, 0.05, 0.1, 0.3, 0.6):
            pool = rng.integers(0, 1 << 63, n + m, dtype=np.uint64)
            a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[int(n * part) : n], pool[n : n + max(0, m - n + int(n * part))]]))
            shared = len(np.intersect1d(a, b))
            rows.append((len(a), len(b), *(ngram_join._parity(x).tolist() for x in (a, b)), 100 * shared >= 75 * (len(a) + len(b) - shared)))
    df = spark.createDataFrame(rows, "n int, m int, a array<long>, b array<long>, link boolean")
    may = [(r.link, r.may) for r in df.withColumn("may", ngram_join._may_reach(F.col("n"), F.col("m"), F.col("a"), F.col("b"), 75)).collect()]
    assert all(m for link, m in may if link) and any(link for link, _ in may) and sum(not m for _, m in may) > 10


def test_components(spark, monkeypatch):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 30) if k != 17] + [(40, 40), (5, 6)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {k: 0 if k <= 17 else 18 for k in range(31)}
    assert components.components(edges.limit(0)).count() == 0
    monkeypatch.setattr(components, "MANY", 5)
    rng = random.Random(1)
    pairs = [(0, k) for k in range(1, 60)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(40)]
    up = {x: x for p in pairs for x in p if p[0] != p[1]}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            lo, hi = sorted((top(a), top(b)))
            up[hi] = lo
    assert {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()} == {x: top(x) for x in up}


def test_rollups(spark, tmp_path):
    rows = spark.createDataFrame([("s", "en", 5), ("s", "en", 3), (None, None, 0)], "source string, lang string, n long")
    v1, v2, n = F.lit("v1"), F.lit("v2"), F.col("n")
    r = token_rollups.Rollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0
    r.commit(0, token_rollups.signed(rows, v1, n, 1))
    for _ in range(2):
        r.commit(1, token_rollups.revised(rows.filter("n = 5"), (v1, n), (v2, n + 1)))
    r.commit(2, token_rollups.signed(rows.filter("source is null"), v1, n, -1))
    want = {("s", "en", "v1", 1, 3), ("s", "en", "v2", 1, 6)}
    assert set(map(tuple, r.totals().collect())) == want
    folded = r.folded(str(tmp_path / "f"))
    assert set(map(tuple, folded.totals().collect())) == want
    folded.commit(3, token_rollups.signed(rows.filter("n = 3"), v1, n, -1))
    assert set(map(tuple, folded.totals().collect())) == {("s", "en", "v2", 1, 6)}
    changes = token_rollups.signed(rows, v1, n, 1)
    changes.write.parquet(str(tmp_path / "c"))
    s = token_rollups.Rollup(spark, str(tmp_path / "s"))
    s.follow(spark.readStream.schema(changes.schema).parquet(str(tmp_path / "c")), str(tmp_path / "k")).awaitTermination()
    assert s.totals().agg(F.sum("n_tokens")).first()[0] == 8


def test_classifier(spark, odd):
    x = np.random.default_rng(1).normal(size=(3000, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] < -0.5)).astype(float)
    forest = quality.fit(x[:2000], y[:2000], trees=30)
    assert ((forest.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert quality.fit(x[:5], np.ones(5)).score(x[:2]).tolist() == pytest.approx([6 / 7, 6 / 7])
    labels = spark.read.parquet(f"{D}/labels.parquet")
    docs = spark.read.parquet(f"{D}/documents.parquet")
    scored = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert np.mean([(scored[r.doc_id] >= 0.3) == (r.quality == 1) for r in labels.collect()]) > 0.9
    none = quality.train(odd, labels.limit(0))
    assert {r.score for r in quality.score(odd, none).collect()} == {0.5}
    assert quality.accepted(odd, labels.limit(0)).columns == odd.columns
    assert quality.score(odd.limit(0), none).count() == 0
    again = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert again == scored


def test_statistics_in_parts(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["", None, "x" * 300, "", "One two TWO!!\nthree ###", "é" * 50, "a | b | c", "x" * 300] * 7)
    whole = quality.statistics(texts)
    monkeypatch.setattr(quality, "BLOCK", 64)
    assert np.allclose(whole, quality.statistics(texts)) and np.isfinite(whole).all()


def test_pipeline(spark):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for name, stage_of in corpus_pipeline.STAGES:
        seen.append(stage(stage_of(spark, seen[-1], D), name))
    assert [s.columns == columns for s in seen] == [True] * 5 + [False]
    good, distinct, apart, mix, ids = seen[1:]
    bad = {r.doc_id for r in labels.filter("quality = 0").collect()}
    assert len(bad & {r.doc_id for r in good.collect()}) <= 0.3 * len(bad)
    assert good.count() >= 0.9 * docs.join(labels.filter("quality = 0"), "doc_id", "left_anti").count()
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text) for r in distinct.collect()]
    assert len(set(texts)) == len(texts) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r.text) for r in good.collect()})
    want = brute_components([(r.doc_id, r.text) for r in distinct.collect()])
    assert sorted(r.doc_id for r in apart.collect()) == sorted({c for _, c in want.values()})
    times = {r.doc_id: r.times for r in mixing.mix(apart).collect()}
    assert {i: n for i, n in times.items() if n} == {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    digest = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in mix.collect()}
    assert ids.count() == mix.count() and all(r.decoded_sha256 == digest[r.doc_id] for r in ids.collect())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = registry.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*cols).collect()))) == sorted(map(str, con.sql(registry.ORACLE_SQL[name]).select(*cols).fetchall()))
