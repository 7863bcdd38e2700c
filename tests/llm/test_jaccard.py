"""Operator 10 against all-pairs comparison."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SMALL

from mentionlake.llm import jaccard_join as J
from mentionlake.llm.common import table


def brute(rows):
    """{row number: (set size, smallest id reachable)} by counting overlaps through inverted lists."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = min(4, len(words))
        sets.append(frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else frozenset())
    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            lists[x].append(i)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in lists[x] if j < i).items():
            if 100 * both >= 85 * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    low = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            low[find(i)] = min(low.get(find(i), key), key)
    return sorted((repr(rows[i][0]), len(sets[i]), repr(low.get(find(i)) if sets[i] else rows[i][0])) for i in range(len(rows)))


def run(spark, rows, **how):
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS size", "1 AS set_id", "0 AS component")
    return sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in J.components(frame, **how).collect())


@pytest.fixture(scope="module")
def family():
    """Short and long texts with chains of edits, a passage that many share, copies, nulls and ties."""
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(1, 6)))
    passage = [word() for _ in range(60)]
    texts = [None, "", "   ", "one", "ONE", "one two three", "one two three four", "a a a a a a a a", "a a a a"]
    for _ in range(14):
        words = [word() for _ in range(r.choice([9, 12, 16, 20, 23, 40, 90, 200]))]
        for _ in range(r.randint(1, 12)):
            words = list(words)
            for _ in range(r.choice([0, 1, 1, 2])):
                words[r.randrange(len(words))] = word()
            if r.random() < 0.3:
                words = words[: -r.randint(1, 3)]
            texts.append(" ".join(words))
            if r.random() < 0.2:
                texts.append(texts[-1].upper())
    texts += [" ".join([*passage, *[word() for _ in range(r.randint(1, 40))]]) for _ in range(30)]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    return [*rows, rows[20], rows[20], (None, rows[30][1]), (None, "nobody else has this text at all")]


def test_family(spark, family):
    assert run(spark, family) == brute(family)


@pytest.mark.parametrize("how", [{"hot": 4, "boundary": 1, "crowded": 0}, {"boundary": 16, "broadcast_sets": 1}])
def test_plans_and_bounds_do_not_change_links(spark, family, how):
    assert run(spark, family, **how) == brute(family)


def test_ids_of_sets_are_joined_not_collected(spark, monkeypatch):
    from conftest import plan_text
    from pyspark.sql import DataFrame

    def refuse(*_):
        raise AssertionError("rows on the driver")

    texts = spark.createDataFrame([("a b c d e",), ("a b c d e",), ("f g h i j",)], "text string")
    wanted = J.set_id(J.Shingler().tokens("a b c d e"))
    ids = spark.createDataFrame([(wanted,)], "set_id long")
    with monkeypatch.context() as m:
        for name in ("collect", "toArrow", "toPandas", "count"):
            m.setattr(type(texts), name, refuse)
            m.setattr(DataFrame, name, refuse)
        found = J._tokens_of(texts, ids, 4)
    assert [r.set_id for r in found.collect()] == [wanted]
    assert "Broadcast" not in plan_text(found)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    got = J.op10_jaccard_join(spark, SMALL).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_boundary_follows_cost():
    sizes = dict.fromkeys(range(1, 33), 100)
    assert J.choose_boundary(sizes, 0.0) <= J.choose_boundary(sizes, 0.3) <= J.choose_boundary(sizes, 1.0)
    assert J.choose_boundary({}, 0.5) == 1


def test_light_subsets_and_prefixes_suffice():
    for a in range(1, 60):
        for b in range(a, 60):
            need = J.least_overlap(a, b)
            assert (need <= a) == (100 * a >= 85 * b)
            if need <= a:
                assert a - need < J.prefix_length(a) and b - need < J.prefix_length(b)


def test_list_rows_leave_in_portions():
    """Before, a task handed on the rows of up to 5,000 lists at once, whatever their length."""
    import types

    import pyarrow as pa

    texts = [" ".join(f"{i}w{j}" for j in range(400)) for i in range(3000)]
    run = J._list_rows(4, 85, 1, types.SimpleNamespace(value=np.zeros(0, np.uint32)))
    sizes = [b.num_rows for b in run(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))]
    assert sum(sizes) == 3000 * J.prefix_length(397) and max(sizes) <= J.FLUSH_ROWS + 397


def test_a_shared_passage_is_one_list_and_gives_each_pair_once(spark, monkeypatch):
    """Before, each shingle of the passage was a list of its own, and each of them made every pair of its sets."""
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdefghij", k=8))
    passage = [word() for _ in range(100)]
    rows = [(i, " ".join([*passage, *[word() for _ in range(10)]])) for i in range(20)]
    rows += [(100 + i, rows[i][1].rsplit(" ", 2)[0]) for i in range(5)]
    seen, made, keep, cross = defaultdict(list), [], J.materialize, J._cross_pairs

    def spy(df, label):
        out = keep(df, label)
        seen[label].append(out.count())
        return out

    def count(*a):
        out = cross(*a)
        made.append((out.count(), out.distinct().count()))
        return out

    monkeypatch.setattr(J, "materialize", spy)
    monkeypatch.setattr(J, "_cross_pairs", count)
    assert run(spark, rows) == brute(rows)
    assert seen["heavy-lists"][0] < seen["shared-lists"][0] / 3
    assert made and all(n <= max(once, 1) for n, once in made)


@pytest.mark.parametrize("first", [0, 1])
def test_first_keys_do_not_change_links(spark, family, monkeypatch, first):
    monkeypatch.setattr(J, "FIRST_KEYS", first)
    assert run(spark, family, boundary=1) == brute(family)


def test_unlike_sets_of_a_short_list_are_no_pairs(spark):
    """Before, lists of up to 32 sets made all their pairs; here ten sets share 12 of 60 shingles in 12 lists, and two are alike."""
    r = np.random.default_rng(2)
    shared = np.sort(r.integers(0, 1 << 63, 12, np.uint64))
    sets = {i: np.concatenate((shared, r.integers(0, 1 << 63, 48, np.uint64))) for i in range(10)}
    sets[10] = np.concatenate((sets[9][:-2], r.integers(0, 1 << 63, 2, np.uint64)))
    tokens = spark.createDataFrame([(i, bytearray(np.sort(x).tobytes())) for i, x in sets.items()], "set_id long, tokens binary")
    rows = [(int(k), i, 60, 5, i) for i in sets for k in shared]
    rows = spark.createDataFrame(rows, "key long, set_id long, size int, pos int, component long")
    assert [(x.a, x.b) for x in J._cross_pairs(rows, J._bitmaps(tokens), 85, 1).collect()] == [(9, 10)]
