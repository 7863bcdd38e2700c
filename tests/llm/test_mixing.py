"""Operator 11 against SQL, a plain water-filling, and numerically integrated schedules."""

import random
from collections import Counter, defaultdict

import pytest
from conftest import SMALL, plan_text
from oracle_check import compare, duck
from pyspark.sql import functions as F

from mentionlake.llm import mixing as M

KNOTS = "source string, at double, weight double"


def shares(sizes, weights, most=3):
    """Targets by resharing the excess round by round."""
    total, capped = sum(sizes.values()), set()
    while True:
        free = sum(w for s, w in weights.items() if s not in capped)
        left = total - sum(most * sizes[s] for s in capped)
        target = {s: most * sizes[s] if s in capped else left * w / free for s, w in weights.items()}
        over = {s for s in target if s not in capped and target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def test_sql(spark):
    assert compare(spark, duck(SMALL), M.op11_mixing, M.OP11_SQL, SMALL)[0] == "ok"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    rows = [(i if i % 40 else None, " ".join(["w"] * r.randint(0, 30)) if i % 25 else None, r.choices(["hot", "b", "é", "tiny", None], [60, 20, 20, 2, 3])[0], "x", i) for i in range(1500)]
    rows += [(7, "one two three", "hot", "x", 7)] * 400  # one row repeated
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, before long")


def test_targets_and_copies(spark, docs):
    weights = {"hot": 1.0, "b": 5.0, "é": 2.0, "tiny": 9.0, None: 1.0}
    flat = spark.createDataFrame([(s, 0.5, w) for s, w in weights.items()] + [("absent", 0.0, 50.0)], KNOTS)
    got = M.mix(docs, flat).collect()
    assert len(got) == docs.count()
    assert got[0].asDict().keys() == {*docs.columns, "mix"}
    sizes, taken, longest = Counter(), Counter(), defaultdict(int)
    for r in got:
        n = len((r.text or "").split())
        assert r.mix.size == n and r.mix.taken == n * r.mix.copies == n * len(r.mix.positions) and r.mix.copies <= 3
        sizes[r.source] += n
        taken[r.source] += r.mix.taken
        longest[r.source] = max(longest[r.source], n)
    want = shares(sizes, weights)
    assert want["tiny"] == 3 * sizes["tiny"]
    for r in got:
        assert r.mix.source_size == sizes[r.source] and r.mix.target == pytest.approx(want[r.source])
    for s in weights:
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1e-6
    again = M.mix(docs.repartition(7), flat).collect()
    assert Counter(map(repr, got)) == Counter(map(repr, again))


def test_positions_follow_the_schedule(spark, docs):
    knots = [("hot", 0.0, 2.0), ("hot", 0.5, 2.0), ("hot", 0.5001, 0.0), ("hot", 1.0, 4.0), ("b", 0.2, 0.0), ("b", 0.4, 3.0), ("b", 2.0, 99.0), ("é", 0.0, None), ("tiny", 0.0, float("nan"))]
    got = M.mix(docs, spark.createDataFrame(knots, KNOTS)).collect()
    assert all(not r.mix.positions and r.mix.target == 0 for r in got if r.source in ("é", "tiny", None))

    def weight(s, t):
        ks = [k[1:] for k in knots if k[0] == s and k[1] <= 1]
        if t <= ks[0][0]:
            return ks[0][1]
        for (a, x), (b, y) in zip(ks, ks[1:]):
            if a <= t <= b and b > a:
                return x + (y - x) * (t - a) / (b - a)
        return ks[-1][1]

    steps = 4000
    for s in ("hot", "b"):
        whole = sum(weight(s, (i + 0.5) / steps) for i in range(steps))
        words = [(p, r.mix.size) for r in got if r.source == s for p in r.mix.positions]
        total = sum(n for _, n in words)
        for t in (0.1, 0.3, 0.5, 0.8, 0.95):
            due = sum(weight(s, (i + 0.5) / steps) for i in range(int(steps * t))) / whole
            assert sum(n for p, n in words if p < t) / total == pytest.approx(due, abs=0.02)


def test_training_order(spark, docs):
    out = M.training_order(docs.withColumn("position", F.lit("mine")), M.cycled_schedule(docs))
    rows = out.collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows) and rows[0].position >= 0 and rows[-1].position <= 1
    assert sum(len((r.text or "").split()) for r in rows) == sum(r.mix.taken for r in M.mix(docs, M.cycled_schedule(docs)).collect())


def test_cycle_and_empty(spark, docs):
    at = {(r.source, r["at"]): r.weight for r in M.cycled_schedule(docs).collect()}
    assert [at[s, 0.0] for s in ("b", "hot", "tiny", "é", None)] == [7.5, 2.0, 0.5, 7.5, 2.0]
    none = docs.limit(0)
    assert M.mix(none, M.cycled_schedule(none)).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.mix.size, r.mix.taken, r.mix.target) for r in M.mix(blank, M.cycled_schedule(blank)).collect()] == [(0, 0, 0.0)] * 2


def test_native(spark):
    plan = plan_text(M.op11_mixing(spark, SMALL))
    assert "Python" not in plan and "Arrow" not in plan
