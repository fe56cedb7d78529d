"""Edits that the trees locate, and neighbours of repeated and null ids: against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from foilframe.llm import merkle


def located(old, new):
    """The spans, after checking that outside of them both texts are the same, and that there are none only if they are."""
    spans = merkle.Tree(new).edits(merkle.Tree(old))
    a, b = new.encode(), old.encode()
    x = y = 0
    for s, e, t, u in spans:
        assert x <= s <= e and y <= t <= u and (s < e or t < u) and a[x:s] == b[y:t]
        x, y = e, u
    assert a[x:] == b[y:] and (not spans) == (old == new)
    return spans


@pytest.mark.parametrize("seed", range(8))
def test_random_edits_repeats_and_moves(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(25)]
    for _ in range(120):
        old = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(0, 30))]
        new = list(old)
        for _ in range(rng.randint(0, 4)):
            k = rng.random()
            if k < 0.25 and new:
                new[rng.randrange(len(new))] = rng.choice(new)  # a line that stands elsewhere too
            elif k < 0.5 and new:
                i = rng.randrange(len(new))
                new += new[i : i + 8]  # a repeated section
            elif k < 0.7 and new:
                del new[rng.randrange(len(new))]
            elif k < 0.9 and new:
                new.insert(rng.randrange(len(new)), new.pop(rng.randrange(len(new))))
            else:
                new.append("words of its own")
        located("\n".join(old), "\n".join(new))


def test_cases_that_hide_in_counts():
    sections = ["\n".join(f"section {s} line {k} with some words" for k in range(9)) + "\n\n" for s in range(5)]
    text = "".join(sections)
    assert located(text, "".join(sections[:3] + [sections[0]] + sections[4:]))
    assert located(text, text + sections[2])
    assert located(text, text.replace("section 1 line 3 with", "section 1 line 4 with"))
    assert located(text, "".join(sections[:2] + sections[3:]))[0][:2] == (len(sections[0] + sections[1]),) * 2
    assert located("", text) == [(0, len(text), 0, 0)] and located(text, "") == [(0, 0, 0, len(text))]
    long = "\n".join(str(k * 7919 % 100003) for k in range(20000))
    assert located(long, long[:50000] + "x" + long[50000:])[0][1] < 50200
    assert sum(e - s for s, e, _, _ in located("a\nb\n" * 9000, "b\na\n" * 9000)) <= 36000


def test_neighbours_of_repeated_and_null_ids(spark):
    rows = [(k % 40 if k % 5 else None, f"text {k} " * (k % 9) if k % 7 else None) for k in range(300)] + [(7, "same"), (7, "same"), (None, "same")]
    for kind in ("long", "string"):
        df = spark.createDataFrame([(None if i is None else i if kind == "long" else f"id{i:03d}", t, "clash") for i, t in rows], f"doc_id {kind}, text string, tail string").repartition(5)
        hashed = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h")).collect()
        named = sorted((r for r in hashed if r.doc_id is not None), key=lambda r: r.h)
        order = sorted(named, key=lambda r: r.doc_id, reverse=True) + sorted((r for r in hashed if r.doc_id is None), key=lambda r: r.h)
        want = []
        for r, after in zip(order, order[1:] + order[:1]):
            a, b = merkle.Tree(r.text), merkle.Tree(after.text)
            new = merkle.Tree(merkle.edited(r.text, after.text))
            want.append((str(r.doc_id), a.fingerprint, new.fingerprint, round(a.likeness(new), 9), round(a.likeness(b), 9)))
        got = merkle.compare_with_next(df).collect()
        assert sorted(want) == sorted((str(r.doc_id), r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got)
    one = merkle.compare_with_next(df.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_likeness_is_the_share_of_bytes_in_equal_leaves():
    rng = random.Random(3)
    for _ in range(60):
        a, b = (merkle.Tree("\n".join(rng.choice(["one two three", "four five", "", "six " * 30]) for _ in range(rng.randint(0, 12)))) for _ in range(2))
        left, shared = [h for h, _, _ in a.leaves], 0
        for h, s, e in b.leaves:
            if h in left:
                left.remove(h)
                shared += e - s
        assert a.likeness(b) == pytest.approx(1.0 if a.root == b.root else 2 * shared / (a.size + b.size))
