import random
import re

import pytest
from conftest import SMALL, plan_text
from pyspark.sql import functions as F

from mentionlake.functions.scalars import literal_table
from mentionlake.operators import similarity as S
from mentionlake.sources import tables as T


def words(title):
    return {w for w in re.split(r"\s+", re.sub(r"[^a-z0-9\s]", "", title.lower()).strip()) if len(w) > 3}


def similar(a, b, t):
    return bool(a) and bool(b) and len(a & b) / max(len(a), len(b)) > t


def brute(rows, t, compat=False):
    sets = {i: (ts, words(title)) for i, title, ts in rows}
    out = {}
    for i, (ts, ws) in sets.items():
        earlier = [(o_ts, j) for j, (o_ts, o) in sets.items() if j != i and similar(ws, o, t) and ((o_ts, j) < (ts, i) or (compat and o_ts <= ts))]
        out[i] = (bool(earlier), min(e for e in earlier if (e[0], e[1]) < (ts, i))[1] if any((e[0], e[1]) < (ts, i) for e in earlier) else None)
    return out


def frame(spark, rows):
    base = literal_table(spark, "id bigint, title string, day int", rows)
    ts = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.col("day"))
    return base.select("id", "title", ts.alias("published_at"), ts.alias("fetched_at"))


def random_rows(seed, n):
    rng = random.Random(seed)
    vocab = [f"word{i}" for i in range(40)]
    rows = []
    for i in range(n):
        if rng.random() < 0.35:
            title = "breaking storm hits northern coast while ferries remain docked " + (f"update{rng.randrange(6)}" if rng.random() < 0.7 else "")
        else:
            title = " ".join(rng.sample(vocab, rng.randrange(1, 8)))
        rows.append((i, title, rng.randrange(20)))
    return rows


@pytest.mark.parametrize("seed,tuning", [(1, {}), (2, {"small": 1, "frequent": 1}), (3, {"small": 4, "frequent": 5}), (4, {"small": 2, "frequent": 1000})])
def test_equals_brute_force(spark, seed, tuning):
    rows = random_rows(seed, 220)
    out = S.near_duplicates(frame(spark, rows), window_days=None, **tuning)
    assert {r.id: (r.is_duplicate, r.duplicate_of) for r in out.collect()} == brute(rows, 0.65)


def test_compat_ties(spark):
    rows = random_rows(9, 150)
    out = S.near_duplicates(frame(spark, rows), window_days=None, compat=True, small=3, frequent=10)
    assert {r.id: r.is_duplicate for r in out.collect()} == {i: d for i, (d, _) in brute(rows, 0.65, compat=True).items()}


def test_threshold_edges(spark):
    base = [f"word{i:02d}" for i in range(20)]
    rows = [(1, " ".join(base), 0), (2, " ".join(base[:13] + [f"xxxx{i}" for i in range(7)]), 1), (3, " ".join(base[:14] + [f"yyyy{i}" for i in range(6)]), 1),
            (4, "海洋能源", 0), (5, "海洋能源", 0), (6, "", 0)]
    out = {r.id: (r.is_duplicate, r.duplicate_of) for r in S.near_duplicates(frame(spark, rows), window_days=None).collect()}
    assert out == {1: (False, None), 2: (False, None), 3: (True, 1), 4: (False, None), 5: (False, None), 6: (False, None)}


def test_window_and_null_dates(spark):
    df = frame(spark, [(1, "wave power plant opens", 0), (2, "wave power plant opens", 20), (3, "wave power plant opens", 21)])
    recent = S.near_duplicates(df, "2024-01-23", window_days=7)
    assert {r.id: r.duplicate_of for r in recent.collect()} == {2: None, 3: 2}
    undated = df.withColumn("published_at", F.when(F.col("id") != 2, F.col("published_at")))
    assert {r.id: r.duplicate_of for r in S.near_duplicates(undated, window_days=None).collect()} == {1: 2, 2: None, 3: 2}


def components(rows, t):
    sets = {i: words(title) for i, title, _ in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and similar(sets[i], sets[j], t):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in sets:
        groups.setdefault(find(i), []).append(i)
    return {i: min(g) for g in groups.values() if len(g) > 1 for i in g}


@pytest.mark.parametrize("seed,tuning", [(5, {}), (6, {"small": 2, "frequent": 3})])
def test_clusters_equal_brute_force(spark, seed, tuning):
    rows = random_rows(seed, 150)
    out = S.cluster_stories(frame(spark, rows), window_days=None, **tuning)
    assert {r.id: r.story_cluster_id for r in out.collect()} == components(rows, 0.5)


def test_chain_is_one_cluster(spark):
    rows = [(1, "alpha bravo charlie delta", 0), (2, "bravo charlie delta echo1", 1), (3, "charlie delta echo1 foxtrot", 2), (4, "unrelated single story", 3)]
    out = {r.id: r.story_cluster_id for r in S.cluster_stories(frame(spark, rows), window_days=None).collect()}
    assert out == {1: 1, 2: 1, 3: 1}


def test_components_of_long_path_and_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    df = literal_table(spark, "a bigint, b bigint", edges)
    out = {r.node: r.component for r in S.connected_components(df).collect()}
    assert {out[i] for i in range(61)} == {0} and {out[1000 + i] for i in range(200)} == {1000}


def test_no_nested_loops(spark):
    out = S.near_duplicates(T.articles_from_documents(spark, SMALL), window_days=None)
    assert "NestedLoop" not in plan_text(out) and "Cartesian" not in plan_text(out)


def test_copies_are_not_enumerated(spark):
    """A third exact copies and a third near copies: links stay linear in the input."""
    n = 3000
    i = F.col("id")
    title = (
        F.when(i % 3 == 0, "breaking storm hits northern coast while ferries remain docked")
        .when(i % 3 == 1, F.concat(F.lit("quarterly results beat every analyst forecast number"), i.cast("string")))
        .otherwise(F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.pmod(F.xxhash64(i, F.lit(k)), F.lit(500)).cast("string")) for k in range(6)]))
    )
    ts = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), i.cast("int"))
    df = spark.range(n).select("id", title.alias("title"), ts.alias("published_at"))
    rows = S._title_rows(df)
    sets = S._word_sets(rows).select("set_key", "sid", "first.ord", "first.first_id")
    assert S.set_links(sets, 0.65).count() < 3 * n
    flagged = S.near_duplicates(df, window_days=None).filter("is_duplicate").count()
    assert flagged >= 2 * (n // 3) - 2


@pytest.mark.parametrize("threshold", [0.5, 0.65])
def test_short_titles_against_brute_force(spark, threshold):
    import random

    r = random.Random(11)
    words = [f"word{c}" for c in "abcdefg"]
    rows = [(i, " ".join(r.sample(words, r.randint(1, 4))), i % 5) for i in range(160)]
    sets = S._word_sets(S._title_rows(frame(spark, rows))).select("set_key", "sid", "first.ord", "first.first_id")
    for tuning in ({}, {"frequent": 3, "small": 2}):
        links = S.set_links(sets, threshold, **tuning).select("a", "b")
        got = {r.node: r.component for r in S.connected_components(links).collect()}
        keys = {r.sid: set(r.set_key.split()) for r in sets.collect()}
        parent = {k: k for k in keys}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for x in keys:
            for y in keys:
                if x < y and len(keys[x] & keys[y]) / max(len(keys[x]), len(keys[y])) > threshold:
                    parent[max(find(x), find(y))] = min(find(x), find(y))
        assert {k: got.get(k, k) for k in keys} == {k: find(k) for k in keys}


@pytest.mark.parametrize("threshold", [0.5, 0.65])
def test_unlike_titles_that_share_two_frequent_words_do_not_meet(spark, threshold):
    n = 20_000
    rare = [F.concat(F.lit(f"w{k}x"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(100_000)).cast("string")) for k in range(3)]
    df = spark.range(n).select("id", F.concat_ws(" ", F.lit("market report"), *rare).alias("title"), F.lit("2024-01-01").cast("timestamp").alias("published_at"))
    sets = S._word_sets(S._title_rows(df)).select("set_key", "sid", "first.ord", "first.first_id")
    keys = S._ordered_sets(sets, threshold).select(F.explode(S._keys(S.FREQUENT_WORD)).alias("key")).groupBy("key").count()
    assert keys.agg(F.sum(F.col("count") * F.col("count"))).first()[0] < 8 * n


@pytest.mark.parametrize("threshold", [0.5, 0.65])
def test_pairs_in_crowded_keys_grow_with_the_sets(spark, threshold):
    """Unlike titles from few words, all with two words in common: longer keys keep the pairs about linear."""

    def met(n):
        words = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: F.struct(F.xxhash64("id", k).alias("h"), F.concat(F.lit("word"), k).alias("w"))))
        df = spark.range(n).select("id", F.concat(F.lit("market report "), F.array_join(F.transform(F.slice(words, 1, 6), lambda x: x["w"]), " ")).alias("title"), F.lit("2024-01-01").cast("timestamp").alias("published_at"))
        sets = S._word_sets(S._title_rows(df)).select("set_key", "sid", "first.ord", "first.first_id")
        trace = []
        S.set_links(sets, threshold, frequent=200, trace=trace).write.format("noop").mode("overwrite").save()
        return sum(p for _, p in trace), trace

    few, many = met(2500), met(20_000)
    assert len(many[1]) > 1
    assert many[0] < 2.5 * 8 * few[0] and many[0] < 400 * 20_000  # all pairs would be 200 million, 64 times as many


def test_small_round_sizes_on_crowded_random_titles(spark):
    rng = random.Random(31)
    vocab = [f"word{i}" for i in range(14)]
    rows = [(i, " ".join(rng.sample(vocab, rng.randrange(2, 9))), rng.randrange(6)) for i in range(260)]
    for threshold, tuning in ((0.65, {"small": 1, "frequent": 1}), (0.5, {"small": 3, "frequent": 10_000})):
        out = S.near_duplicates(frame(spark, rows), window_days=None, threshold=threshold, **tuning)
        assert {r.id: (r.is_duplicate, r.duplicate_of) for r in out.collect()} == brute(rows, threshold)


def test_a_passage_shared_by_unlike_titles_multiplies_no_keys(spark):
    """Longer keys from the words of a passage hold the same sets again: their number must not grow with the choices of its words."""
    threshold, rng = 0.65, random.Random(7)
    passage, vocab = [f"passage{i}" for i in range(16)], [f"common{i}" for i in range(30)]
    rows = [(i, " ".join((passage if i % 3 == 0 else []) + rng.sample(vocab, 16)), rng.randrange(6)) for i in range(300)]
    df = frame(spark, rows)
    sets = S._word_sets(S._title_rows(df)).select("set_key", "sid", "first.ord", "first.first_id")
    trace = []
    S.set_links(sets, threshold, trace=trace).write.format("noop").mode("overwrite").save()
    assert sum(n for n, _ in trace) < 4 * trace[0][0] and len(trace) < 5
    out = S.near_duplicates(df, window_days=None, threshold=threshold)
    assert {r.id: (r.is_duplicate, r.duplicate_of) for r in out.collect()} == brute(rows, threshold)


def test_what_travels_with_a_key_holds_no_words(spark, monkeypatch):
    """A long title has many keys: its words in every entry would cost the square of its length on disk."""
    stored, write = {}, S.materialize
    monkeypatch.setattr(S, "materialize", lambda df, label: stored.setdefault(label, df.schema) and write(df, label))
    rows = [(i, " ".join(f"word{(i // 80 * 7 + k) % 90}" for k in range(40)) + f" extra{i}", i % 5) for i in range(160)]
    out = S.near_duplicates(frame(spark, rows), window_days=None)
    assert {r.id: (r.is_duplicate, r.duplicate_of) for r in out.collect()} == brute(rows, 0.65)
    keyed = {label: schema.simpleString() for label, schema in stored.items() if "key" in schema.names}
    assert {"title-entries", "title-crowds"} <= keyed.keys()
    assert not [label for label, schema in keyed.items() if "array" in schema]


def test_longer_keys_stay_within_a_multiple_of_the_first(spark):
    """Where every key is worth extending, only as many longer entries are written as are allowed; the other keys are compared as they are."""
    rng = random.Random(5)
    vocab, rows = [f"word{i}" for i in range(60)], []
    for i in range(1500):
        ws = rng.sample(vocab, 24)
        if i % 5 == 4:
            ws = rows[rng.randrange(i)][1].split()[rng.randrange(1, 8):] + rng.sample(vocab, 2)
        rows.append((i, " ".join(ws), rng.randrange(20)))
    df, trace = frame(spark, rows), []
    sets = S._word_sets(S._title_rows(df)).select("set_key", "sid", "first.ord", "first.first_id")
    S.set_links(sets, 0.65, trace=trace).write.format("noop").mode("overwrite").save()
    assert len(trace) > 1 and sum(n for n, _ in trace[1:]) <= 2 * trace[0][0]
    out = S.near_duplicates(df, window_days=None)
    got = {r.id: (r.is_duplicate, r.duplicate_of) for r in out.collect()}
    assert got == brute(rows, 0.65) and sum(d for d, _ in got.values()) > 100
