"""Operator 8 against a count of every window, and against SQL."""

import random
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL
from oracle_check import compare, duck

from mentionlake.llm import suffix_dedup as S


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((bytes(np.frombuffer(r, np.uint8)[~gone]), int(gone.sum()), runs))
    return out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    prose = lambda n: "".join(r.choices("abcdeé ", k=n))
    passage, other = prose(130), prose(70)
    out = [None, "", "short", "x" * 49, "x" * 50, "x" * 300, "ab" * 400, "abc" * 60 + prose(20) + "abc" * 60]
    out += [prose(r.randint(0, 90)) + passage + prose(r.randint(0, 90)) for _ in range(12)]
    out += [prose(30) + passage[20:110] + other + prose(30) + other, passage, passage[:50], prose(49) + "é" * 40, "🙂" * 60]
    base = prose(400)
    for _ in range(8):
        k = r.randrange(400)
        out.append(base[:k] + "Q" + base[k + 1 :])
    return [*out, base, base, prose(5000)]


@pytest.mark.parametrize("how", [{}, {"max_bucket": 1}])
def test_removal(spark, texts, how):
    rows = [(i % 7 if i % 3 else None, t, "x") for i, t in enumerate(texts)]
    rows += rows[-3:]  # whole rows repeated
    want = brute([t for _, t, _ in rows], 50)
    frame = spark.createDataFrame(rows, "doc_id long, text string, bucket string")
    got = S.remove_repeats(frame, length=50, gram=16, **how).collect()
    assert sorted((repr(r.doc_id), repr(r.text), bytes(r.cut.kept), r.cut.n_removed, r.cut.n_spans) for r in got) == sorted(
        (repr(k), repr(t), *w) for (k, t, _), w in zip(rows, want, strict=True)
    )


def test_segments_overlap(spark, texts, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", 64)
    monkeypatch.setattr(S, "PLACE", np.uint64(127))
    raw = texts[-1].encode()
    starts = [i for _, a, b, _, _ in S.anchors(raw, 50, 16) for i in range(a, b + 1)]
    assert starts == list(range(len(raw) - 49))


def test_refinement_finds_every_repeated_window():
    r = random.Random(2)
    for length in (8, 9, 30, 77):
        parts = ["".join(r.choices("ab", k=r.randint(0, 400))).encode() for _ in range(9)]
        parts += [parts[3], parts[3][:60], b"a" * 200]
        body, sizes = np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts])
        seen = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
        want = [s + i for s, p in zip(np.cumsum(sizes) - sizes, parts, strict=True) for i in range(len(p) - length + 1) if seen[p[i : i + length]] > 1]
        assert S.repeated_windows(body, sizes, length).tolist() == want


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table_equals_sql(spark):
    status, _, _, diff = compare(spark, duck(SMALL), S.op8_suffix_dedup, S.OP8_SQL, SMALL)
    assert status == "ok", diff


def test_a_run_of_one_letter_is_few_rows():
    rows = list(S.anchors(b"a" * 3_000_000, 400, 32))
    assert len(rows) < 20_000 and rows[0][1] == 0 and rows[-1][2] == 3_000_000 - 400 and any(r[4] for r in rows)
    assert [r[1] for r in rows[1:]] == [r[2] + 1 for r in rows[:-1]]


@pytest.mark.parametrize("texts_", [["a" * 401], ["a" * 400], ["ab" * 500 + "c" * 30 + "ab" * 230], ["a" * 450 + "b" + "a" * 420, "b" + "a" * 401], ["xyz" * 200, "q" + "xyz" * 180]])
def test_periodic_texts(spark, texts_):
    frame = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    got = {r.doc_id: (bytes(r.cut.kept), r.cut.n_removed, r.cut.n_spans) for r in S.remove_repeats(frame).collect()}
    assert got == dict(enumerate(brute(texts_, 400)))
