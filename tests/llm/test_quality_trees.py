"""Flat trees against plain recursion, histogram splits against every split, long texts, ids with two labels."""

import numpy as np
import pytest

from foilframe.llm import quality


def walk(forest, tree, bins, node=0):
    """A row's leaf by plain recursion."""
    inner = forest.feature.shape[1]
    if node >= inner:
        return forest.value[tree, node - inner]
    right = bins[forest.feature[tree, node]] > forest.bin[tree, node]
    return walk(forest, tree, bins, 2 * node + 1 + right)


def test_flat_traversal_equals_recursion():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 5))
    forest = quality.fit(x[:600], (x[:600, 0] * x[:600, 1] > 0).astype(float), trees=12)
    for row in x[600:]:
        bins = forest.binned(row[None])[0]
        assert list(bins) == [int(sum(e < v for e in edges)) for edges, v in zip(forest.edges, row)]
        margin = forest.base + sum(walk(forest, t, bins) for t in range(len(forest.feature)))
        assert forest.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-margin)))
    assert forest.score(x[:0]).shape == (0,)


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(2)
    for seed in range(6):
        x = rng.integers(0, 12, size=(200, 4)).astype(float)
        y = (x[:, seed % 4] + rng.normal(0, 3, 200) > 6).astype(float)
        forest = quality.fit(x, y, trees=1, depth=1)
        p = (y.sum() + 1) / (len(y) + 2)
        g, h = p - y, np.full(len(y), p * (1 - p))
        bins, best = forest.binned(x), -1.0

        def gain(left):
            parts = [(g[s].sum(), h[s].sum()) for s in (left, ~left)]
            if min(b for _, b in parts) < 1:
                return 0.0
            return sum(a**2 / (b + quality.SMOOTH) for a, b in parts) - g.sum() ** 2 / (h.sum() + quality.SMOOTH)

        for k in range(4):
            for cut in range(quality.BINS):
                best = max(best, gain(bins[:, k] <= cut))
        assert gain(bins[:, forest.feature[0, 0]] <= forest.bin[0, 0]) == pytest.approx(best)
        left = bins[:, forest.feature[0, 0]] <= forest.bin[0, 0]
        for side, v in ((left, forest.value[0, 0]), (~left, forest.value[0, 1])):
            assert v == pytest.approx(-quality.RATE * g[side].sum() / (h[side].sum() + quality.SMOOTH))


def test_long_texts_two_labels_and_odd_rows(spark):
    good, bad = "the quick brown fox jumps over it. " * 4, "$$$ ## WIN!!! | | 111 " * 6
    docs = [(i, good if i % 2 else bad) for i in range(300)] + [(900, good * 9000), (901, None), (902, ""), (None, bad), (5, bad * 2)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(7, 0, 0), (7, None, 0), (None, 1, 0), (8, 3, 0), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    forest = quality.train(df, labels)
    rows = quality.score(df, forest).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id is not None and r.doc_id < 300 and r.doc_id % 2}) == 1
    score = {r.doc_id: r.score for r in rows}
    assert score[3] > 0.9 > 0.1 > score[2] and score[901] == score[902]
    again = {r.doc_id: r.score for r in quality.score(df.repartition(7), quality.train(df.repartition(5), labels)).collect()}
    assert again[900] == score[900] and again[3] == score[3]
    few = quality.train(df, labels, max_train=10)
    assert few.score(np.zeros((1, len(quality.FEATURES)))).shape == (1,)
