"""Hard negatives against a plain search, over hot vectors, ties, blocks and rows that take no part."""

import math
import random

import numpy as np
import pytest

from demandloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every=50, positives=5, top=3):
    seen = {}
    for i, v, label in rows:
        if None in (i, v, label) or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v])
        seen[i] = min(seen.get(i, row), row)
    out = []
    for a, (label, v) in seen.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, g) for i, (g, w) in seen.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [(-n, i) for n, i, g in scored if g != label and 50 * -s <= 100 * -n <= 95 * -s][:top]
            out += [(a, p, k + 1, i, -s, n) for k, (n, i) in enumerate(fits)]
    return sorted(out)


def table(n, dim=12, labels=4, seed=1, hot=0.0):
    rng = random.Random(seed)
    centre = [[rng.gauss(0.3, 1) for _ in range(dim)] for _ in range(labels)]
    same = [rng.gauss(0.5, 0.5) for _ in range(dim)]
    rows = []
    for i in range(n):
        label = rng.randrange(labels)
        rows.append((i, same if rng.random() < hot else [c + rng.gauss(0, 0.7) for c in centre[label]], label))
    return rows


def listed(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("rows", [table(600), table(300, labels=1), table(400, hot=0.4), table(60, dim=3, labels=9)], ids=["plain", "one label", "hot vector", "few"])
def test_matches_a_plain_search(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = listed(negatives.hard_negatives(docs, every=10))
    assert got == plain(rows, every=10) and (got or rows[0][2] == 0)


def test_many_small_blocks(spark, monkeypatch):
    for name, value in {"ROWS": 32, "ANCHORS": 8, "GROUP": 2, "CHUNK": 7}.items():
        monkeypatch.setattr(negatives, name, value)
    rows = table(500, seed=6, hot=0.2)
    assert listed(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), every=5)) == plain(rows, every=5)


def test_rows_that_take_no_part_and_odd_ones(spark):
    rows = table(300, seed=9)
    odd = [
        (None, rows[0][1], 1), (1000, None, 1), (1050, rows[0][1], None), (1100, [float("nan")] * 12, 1), (1150, [None] * 12, 1),
        (1200, [float("inf")] * 12, 1), (1250, [], 1), (1300, [5.0], 2), (1350, [0.5] * 40, 1), (-50, rows[3][1], 2), (1400, [1e6] * 12, 3),
    ]
    wide = [(v, *r, "s", 3) for r in rows + odd + rows[:50] + [(0, rows[1][1], 9)] for v in ("x",)]
    docs = spark.createDataFrame(wide, "VEC_ID string, vec_id long, embedding array<float>, label int, slot string, n int")
    assert listed(negatives.hard_negatives(docs)) == plain(rows + odd + [(0, rows[1][1], 9)])
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([(50, [1.0], 1)], SCHEMA)).collect() == []


def test_scores_beyond_doubles_are_exact():
    a, b = np.array([[(1 << 29) + 1, 3]]), np.array([[(1 << 29) + 1, 5]])
    assert negatives._products(a, b)[0, 0] == ((1 << 29) + 1) ** 2 + 15
    with pytest.raises(OverflowError):
        negatives._products(a << 4, b)


def test_best_keeps_ties_by_id():
    best = negatives.Best(1, 2, 2)
    zero = np.zeros(3, int)
    best.add(zero, np.array([0, 0, 1]), np.array([5, 5, 9]), np.array([8, 7, 1]))
    best.add(zero, zero, np.array([5, 4, 5]), np.array([2, 1, 9]))
    assert best.found.tolist() == [[0, 0, 5, 2], [0, 0, 5, 7], [0, 1, 9, 1]]
