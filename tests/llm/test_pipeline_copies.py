"""The pipeline's near-duplicate stage links texts of 0.8 similarity on five words, operator 10 keeps its own values."""

import random

import corpus_pipeline as P
from mentionlake.llm import jaccard_join as J


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_copies_between_080_and_085_go(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefghij", k=7))
    rows = []
    for family in range(20):
        first = [word() for _ in range(100)]
        for k, extra in enumerate((0, 20, 30)):  # J = 1, 96/116 and 96/126 with the first
            rows.append((10 * family + k, " ".join(first + [word() for _ in range(extra)])))
    near = [i for i, t in rows if any(j < i and 100 * len(a & b) >= 80 * len(a | b) for j, u in rows for a, b in [(shingles(t), shingles(u))])]
    assert near == [10 * f + 1 for f in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {x.doc_id for x in P.near_duplicates(spark, docs, "").collect()}
    assert left == {i for i, _ in rows} - set(near)
    assert J.keep_one(docs).count() == len(rows)  # four words and 85 per cent
