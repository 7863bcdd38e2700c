"""The phrase index: equal to the inlined dictionary on random texts, and no text in a shuffle."""

import random
import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from mentionlake.functions.scalars import literal_table
from mentionlake.operators import matching as M, phrases as P
from mentionlake.plans.queries_match import terms as corpus_terms
from mentionlake.sources import tables as T


def random_case(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "ab", "abc", "tide", "wave", "x1", "é", "né", "naïve", "日本", "本語", "c++", "_z"])
    text = lambda n: "".join(w for _ in range(n) for w in (word(), r.choice([" ", " ", " ", "  ", "-", ", ", "", "\n"])))
    texts = [text(r.randint(0, 40)) for _ in range(60)] + ["", " ", None]
    terms = {text(r.randint(1, 4)) for _ in range(150)} | {t[i : i + r.randint(1, 30)] for t in texts[:40] if t for i in range(0, len(t), 17)}
    return texts, sorted((f"k{i % 40}", t) for i, t in enumerate(sorted(terms)))


@pytest.mark.parametrize("how", ["word", "normalized", "substring"])
@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_inlined_dictionary(spark, how, seed, request):
    if seed == 1:
        request.getfixturevalue("shuffled")
    texts, terms = random_case(seed)
    df = literal_table(spark, "id int, title string, description string", [(i % 50, t, None) for i, t in enumerate(texts)])
    dic = literal_table(spark, "keyword string, term string", terms)
    found = [sorted((r.id, str(r.title), tuple(r.matched_keywords)) for r in M.match_terms(df, dic, how=how, max_inline=n).collect()) for n in (10_000, 0)]
    assert found[0] == found[1]
    assert sum(len(x[2]) for x in found[0]) > 100


@pytest.fixture
def shuffled(spark):
    """Both sides of every join are shuffled."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def exchanged(df) -> set[str]:
    """Columns that go through a shuffle or broadcast."""
    plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    nodes = re.findall(r"\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert nodes
    return {re.sub(r"#\d+L?", "", c).strip() for n in nodes for c in n.split(",")}


@pytest.mark.parametrize("how", ["word", "normalized", "substring"])
def test_no_text_is_shuffled(spark, how, shuffled):
    docs = T.articles_from_documents(spark, SMALL)
    out = M.match_terms(docs, corpus_terms(spark), how=how, max_inline=0).select("id", "matched_keywords")
    columns = exchanged(out)
    assert not {c for c in columns if c in ("text", "title", "description", "__hay", "__tokens")}
    assert {"__key", "__digest"} <= columns


def test_hot_phrase_and_many_lengths(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choices(words, k=60)) + " common phrase" for _ in range(80)]
    terms = [("common", "common phrase")] + [(f"n{n}-{k}", " ".join(t.split()[k : k + n])) for n in range(1, 15) for k, t in enumerate(texts[:30])]
    df = literal_table(spark, "id int, title string, description string", [(i, t, "") for i, t in enumerate(texts)])
    dic = literal_table(spark, "keyword string, term string", terms)
    got = {x.id: x.matched_keywords for x in M.match_terms(df, dic, how="word", max_inline=0).collect()}
    assert got == {i: sorted({k for k, s in terms if len(s) >= 4 and f" {s} " in f" {t} "}) for i, t in enumerate(texts)}


def test_sieve_holds_all_pieces(spark):
    pieces = spark.range(3000).select(F.concat(F.lit("p"), "id").alias("piece"), F.pmod("id", F.lit(3)).cast("int").alias("m"))
    sieve = P.Sieve(pieces.select("piece", F.shiftleft(F.lit(1), 0).alias("mark")))
    assert pieces.filter(sieve.passes(F.col("piece")) & (sieve.marks(F.col("piece")) == 1)).count() == 3000
    assert spark.range(3000).filter(sieve.passes(F.concat(F.lit("q"), "id"))).count() < 150
