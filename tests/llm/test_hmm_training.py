"""Baum-Welch counts of whole texts against plain forward and backward passes; counts of widespread words; odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from foilframe.llm import hmm


def plain(model, texts):
    """Counts from unscaled passes in logarithms, text by text."""
    k, c = model.emit.shape
    start, move, emit, total = np.zeros(k), np.zeros((k, k)), np.zeros((k, c)), 0.0
    add = np.logaddexp.reduce
    with np.errstate(divide="ignore"):
        s, m, e = np.log(model.start), np.log(model.move), np.log(model.emit)
    for x in texts:
        a = [s + e[:, x[0]]]
        for o in x[1:]:
            a.append(add(a[-1][:, None] + m, axis=0) + e[:, o])
        b = [np.zeros(k)]
        for o in x[:0:-1]:
            b.append(add(m + e[:, o] + b[-1], axis=1))
        b = b[::-1]
        log = add(a[-1])
        total += log
        for t, o in enumerate(x):
            gamma = np.exp(a[t] + b[t] - log)
            emit[:, o] += gamma
            if t == 0:
                start += gamma
            if t + 1 < len(x):
                move += np.exp(a[t][:, None] + m + e[:, x[t + 1]] + b[t + 1] - log)
    return np.concatenate([start, move.ravel(), emit.ravel(), [total]])


@pytest.mark.parametrize("width, group", [(4, 40), (7, 1 << 18), (64, 100), (512, 1 << 18)])
def test_counts_of_long_texts_are_exact(width, group, monkeypatch):
    monkeypatch.setattr(hmm, "EM_TOKENS", group)
    rng = np.random.default_rng(width)
    model = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3) * 0.3, 3), rng.dirichlet(np.ones(5), 3))
    texts = [rng.integers(0, 5, n).astype("<u2") for n in (1, 2, width, width + 1, 3 * width, 1500, 7, 2 * width - 1, 640)]
    assert np.allclose(model.expected(texts, width), plain(model, texts), rtol=1e-8, atol=1e-8)
    assert model.expected([], width).sum() == 0


def words(text):
    return (text or "").lower().split()


def test_long_texts_widespread_words_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK", 3000)
    monkeypatch.setattr(hmm, "LOOKED_AT", 3)
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{int(w)}" for w in rng.zipf(1.4, int(n)) % 400)) for i, n in enumerate(rng.integers(0, 300, 80))]
    rows += [(100, " ".join(f"w{k % 90}" for k in range(4000))), (101, None), (None, "w1 w2 never"), (None, None), (100, "w1")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, block string").repartition(3)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.held_out, r.train_tokens, round(r.base_score, 6)) for r in hmm.score(df, states=2, rounds=2).collect()), key=str)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in rows:
        tokens = [*words(t), None]
        want.append((i, len(tokens), sum(w in c for w in tokens), held(i), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens), 6)))
    assert got == sorted(want, key=str)


def test_no_cut_in_training(spark):
    """A text far longer than a segment trains the same model whatever the segments are."""
    rng = np.random.default_rng(5)
    kinds = [rng.integers(0, 40, n).astype("<u2").tobytes() for n in (3000, 10, 700)]
    df = spark.createDataFrame([(bytearray(k),) for k in kinds], "classes binary")
    counts = np.bincount(np.concatenate([np.frombuffer(k, "<u2") for k in kinds]), minlength=hmm.CLASSES).astype(float)
    models = []
    for width in (5, 100, 5000):
        before, hmm.SEGMENT = hmm.SEGMENT, width
        model = hmm.Model.first((counts + 1) / (counts + 1).sum(), 3, 1)
        for _ in range(3):
            flat = model.expected([np.frombuffer(k, "<u2") for k in kinds])
            model = hmm.Model.of(flat[:3], flat[3:12].reshape(3, 3), flat[12:-1].reshape(3, -1), (counts + 1) / (counts + 1).sum())
        models.append(model)
        hmm.SEGMENT = before
    assert np.allclose(models[0].move, models[1].move) and np.allclose(models[1].emit, models[2].emit)
    trained = hmm.train(df, counts, states=3, rounds=3, seed=1)
    assert np.allclose(trained.move, models[2].move, atol=1e-9)
