"""Keyword suggestion from the whole text of articles."""

from pyspark.sql import functions as F

from mentionlake.functions.scalars import literal_table
from mentionlake.operators import enrich


def test_suggestions_come_from_the_text_that_is_given(spark):
    rows = [(i, "same title", "same title\nhydrogen pipeline" if i < 6 else "same title\nother words") for i in range(12)]
    a = literal_table(spark, "id int, title string, description string", rows)
    a = a.withColumn("matched_keywords", F.when(F.col("id") < 6, F.array(F.lit("gas"))))
    known = literal_table(spark, "text string", [("gas",)])
    pick = lambda **how: {(r.keyword, r.in_matched, r.in_other) for r in enrich.suggest_keywords(a, known, **how).collect()}
    whole = pick(text=F.concat_ws(" ", "title", "description"))
    assert {("hydrogen", 6, 0), ("pipeline", 6, 0), ("hydrogen pipeline", 6, 0)} <= whole
    assert pick() == pick(text=F.col("title")) == {("same", 6, 6), ("title", 6, 6), ("same title", 6, 6)}


def test_terms_equal_a_plain_count(spark):
    import random
    from collections import Counter

    r = random.Random(3)
    words = [f"word{i}" for i in range(30)] + ["ab", "abc"]
    texts = [" ".join(r.choices(words, weights=[60 / (i + 1) for i in range(32)], k=r.randint(0, 12))) for _ in range(120)]
    tags = [r.choice([None, [], ["k1"], ["k1", "k2"], ["k2", "k2"]]) for _ in texts]
    a = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(zip(texts, tags))], "id int, title string, matched_keywords array<string>")
    known = literal_table(spark, "text string", [("k1",), ("k2",)])

    def terms(t):
        w = [x for x in t.split() if len(x) > 3]
        return set(w) | {f"{x} {y}" for x, y in zip(w, w[1:])}

    hit, other, pair, single, per = Counter(), Counter(), Counter(), Counter(), Counter()
    for t, g in zip(texts, tags):
        single.update(terms(t))
        (hit if g else other).update(terms(t))
        per.update(set(g or []))
        pair.update((k, x) for k in set(g or []) for x in terms(t))
    n = sum(bool(g) for g in tags)
    got = enrich.suggest_keywords(a, known, k=1000).collect()
    assert {x.keyword: (x.in_matched, x.in_other) for x in got} == {t: (c, other[t]) for t, c in hit.items() if c >= 5}
    assert all(abs(x.odds - (x.in_matched + 1) * (len(texts) - n + 2) / ((x.in_other + 1) * (n + 2))) < 1e-9 for x in got)
    lifts = {(x.keyword, x.term): (x.n_both, round(x.lift, 9)) for x in enrich.propose_expansions(a, known, k=1000).collect()}
    assert lifts == {(k, t): (c, round(c * len(texts) / (single[t] * per[k]), 9)) for (k, t), c in pair.items() if c >= 3}
    empty = a.limit(0)
    assert enrich.suggest_keywords(empty, known).collect() == [] and enrich.propose_expansions(empty, known).collect() == []


def test_terms_are_shuffled_as_numbers_and_ties_are_named(spark):
    """Before, every (keyword, term) pair of text was an exchange's key."""
    from conftest import plan_text
    from mentionlake.operators import terms

    rows = [(i, " ".join(f"tied{chr(97 + j)}" for j in range(15)) + " gasoline", ["gasoline"]) for i in range(5)] + [(9, "other words", None), (10, None, ["gasoline"]), (11, "", [])]
    a = literal_table(spark, "id int, title string, matched_keywords array<string>", rows)
    known = literal_table(spark, "text string", [("gasoline",), ("Gasoline",), ("none of them",)])
    counts = terms.label_counts(a.select(F.col("title").alias("text"), F.array(F.lit("seven"), F.lit(""), F.lit(None)).alias("labels"))).groupBy("label", "term").agg(F.sum("n").alias("n"))
    assert "string" not in counts.schema.simpleString() and "hashpartitioning(label" in plan_text(counts)
    assert {(x.label, x.n) for x in counts.filter("term = 0").collect()} == {(0, 7), (spark.range(1).select(F.xxhash64(F.lit('seven'))).first()[0], 7)}
    first = sorted([f"tied{chr(97 + j)}" for j in range(15)] + [f"tied{chr(97 + j)} tied{chr(98 + j)}" for j in range(14)] + ["tiedo gasoline"])
    assert [x.keyword for x in enrich.suggest_keywords(a, known).collect()] == first[:8]
    got = enrich.propose_expansions(a, known).collect()
    assert sorted((x.keyword, x.term, x.n_both, x.lift) for x in got) == [("gasoline", t, 5, 7 / 5) for t in first[:10]]
