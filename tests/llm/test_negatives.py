"""Operator 12 against SQL, all pairs in Python, and the promise of its intervals."""

import math
import random

import numpy as np
import pytest
from conftest import SMALL
from oracle_check import compare, duck

from mentionlake.llm import hard_negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int, id string, score long"


def brute(rows, anchors, few=5, low=80):
    good = [(r[0], [math.floor(256 * np.float64(np.float32(x))) for x in r[1]], r[2]) for r in rows if None not in (r[0], r[1], r[2]) and all(x is not None and math.isfinite(x) for x in r[1])]
    out = []
    for a, v, label in sorted({(i, tuple(v), lab) for i, v, lab in good if anchors(i)}):
        near = sorted((-sum(x * y for x, y in zip(v, w)), i, lab) for i, w, lab in good if i != a)
        for p in [(-s, i) for s, i, lab in near if lab == label][:few]:
            fit = [(-s, i) for s, i, lab in near if lab != label and low * p[0] <= -100 * s <= 100 * p[0]][:few]
            out += [(a, p[1], k + 1, i, p[0], s) for k, (s, i) in enumerate(fit)]
    return sorted(out)


def made(n, dims, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dims))
    rows = [(i, (centres[(k := int(r.integers(6)))] * 0.6 + r.normal(size=dims) * 0.5).round(2).tolist(), k if i % 3 else 1, "x", 0) for i in range(n)]
    rows += [(5000 + i, rows[20][1], 1 + i % 2, "x", 0) for i in range(60)]  # copies of one vector under two labels
    rows += [(9001, None, 1, "x", 0), (9002, rows[1][1], None, "x", 0), (9003, [None] + rows[1][1][1:], 1, "x", 0), (9004, [float("nan")] + rows[1][1][1:], 1, "x", 0), (9005, [float("inf")], 2, "x", 0)]
    return rows + [(9100, [], 1, "x", 0), (9101, rows[3][1][: dims // 2], 2, "x", 0), (None, rows[3][1], 2, "x", 0), (20, rows[20][1], rows[20][2], "x", 0)]


@pytest.mark.parametrize(("n", "dims", "block"), [(400, 24, 4096), (250, 70, 7), (300, 130, 4096)])
def test_all_pairs(spark, n, dims, block, monkeypatch):
    monkeypatch.setattr(N, "ROWS", 64)
    rows = made(n, dims)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = N.mine(frame.repartition(3), frame.vec_id % 20 == 0, block=block)
    assert got.dtypes == [tuple(c.replace("long", "bigint").split()) for c in N.RESULT.split(", ")]
    want = brute(rows, lambda i: i % 20 == 0)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 200


def test_large_numbers_and_empty(spark):
    rows = [(i, [float(2 ** (i % 23)), -3.0e6, 1.0], i % 2, "x", 0) for i in range(40)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, N.mine(frame, frame.vec_id % 10 == 0).collect())) == brute(rows, lambda i: i % 10 == 0)
    assert N.mine(frame.limit(0), frame.vec_id % 10 == 0).collect() == []
    assert N.mine(frame, frame.vec_id < 0).collect() == []
    huge = spark.createDataFrame([(i, [2.0**40], 0, "x", 0) for i in range(3)], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        N.mine(huge, huge.vec_id == 0).collect()


@pytest.mark.parametrize("dims", [1, 64, 100])
def test_intervals_hold_and_prune(dims):
    r = np.random.default_rng(dims)
    rows, anchors = np.floor(256 * r.normal(size=(500, dims)) / dims**0.5), np.floor(256 * r.normal(size=(30, dims)) / dims**0.5)
    rows[0], anchors[0] = 0, 0
    turn = N.rotation(dims)
    low, high = N.intervals(*N.codes_of(rows, turn), N.planes_of(anchors, turn), dims)
    true = rows @ anchors.T
    assert (low <= true).all() and (true <= high).all()
    if dims > 1:
        assert ((high - low) / 2 < 0.18 * np.linalg.norm(rows, axis=1)[:, None] * np.linalg.norm(anchors, axis=1) + 1e-6).mean() > 0.95


def test_best_few():
    r = random.Random(2)
    best, all_ = N.Best(7, 3), []
    for _ in range(20):
        new = [(r.randrange(7), r.randrange(10), r.randrange(1000)) for _ in range(r.randrange(12))]
        all_ += new
        best.add(*np.array(new, np.int64).reshape(-1, 3).T)
    for g in range(7):
        want = sorted((-s, i) for h, s, i in all_ if h == g)[:3]
        assert [(-int(s), int(i)) for s, i in zip(best.score[g], best.id[g])][: int(best.n[g])] == want


def test_sql(spark):
    assert compare(spark, duck(SMALL), N.op12_hard_negatives, N.OP12_SQL, SMALL)[0] == "ok"
