"""Quality rules (operator 1): a hashed n-gram log-likelihood ratio beside simple base rules.

Words and word pairs are hashed into ``BUCKETS`` slots. One pass counts the slots over the
whole corpus and over its trusted documents; a slot's weight is the logarithm of its share in
the trusted text over its share in the corpus, in millionths. A document's score is the mean
weight of its n-grams, so length does not matter, and integer sums make it the same whatever
order rows are read in. Everything is built from SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.llm.common import let, table, whole

BUCKETS = 1 << 14
UNIT = 1_000_000
#: Between the scores of documents labelled good (over -0.07) and bad (under -0.1 for most) in the given tables.
THRESHOLD = -0.1
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = "[#*$%&|<>]"
#: Repeated hashes up to this many are looked up window by window; with more, all windows of a text are sorted.
FEW = 16
#: Trusted ids up to this many are broadcast; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that the text holds at least twice.

    Windows are sorted with their places, so equal ones are neighbours: n log n steps. Their hashes are sorted
    first: without a repeated hash nothing is repeated, and of few repeated ones only their windows are compared as words.
    """
    starts = F.sequence(F.lit(0), F.size(words) - 3)
    window = lambda i: [F.get(words, i + k) for k in range(3)]

    def places(hashes: Column, twice: Column) -> Column:
        at = F.when(F.size(twice) <= FEW, F.filter(starts, lambda i: F.array_contains(twice, F.get(hashes, i)))).otherwise(starts)
        windows = F.transform(at, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("g"), i.alias("p")))
        return let(F.sort_array(windows), lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["g"] == x["g"]) | (F.get(s, k + 1)["g"] == x["g"])))

    def repeated(hashes: Column) -> Column:
        return let(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(s, lambda x, k: F.get(s, k + 1) == x)))

    def covered(found: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        step = lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n"), (p + 3).alias("end"))
        return F.aggregate(F.sort_array(F.transform(found, lambda x: x["p"])), start, step)["n"]

    none = F.lit(0).cast("long")
    found = lambda h: let(repeated(h), lambda t: F.when(F.size(t) > 0, covered(places(h, t))).otherwise(none))
    return F.when(F.size(words) >= 3, let(F.transform(starts, lambda i: F.xxhash64(*window(i))), found)).otherwise(none)


def with_base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with __words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    body = whole(text)
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    docs = docs.withColumn("__words", word_list(body))
    docs = docs.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.regexp_count(body, F.lit(SYMBOL)).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeat_words(F.col("__words")),
        }
    )
    return docs.withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))


def slot_list(words: Column, buckets: int) -> Column:
    """The slots of all words and of all pairs of neighbours, in lower case."""
    singles = lambda w: F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
    pairs = lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.pmod(F.xxhash64(F.get(w, i), F.get(w, i + 1)), F.lit(buckets)).cast("int")
    )
    return let(F.transform(words, F.lower), lambda w: F.when(F.size(w) > 1, F.concat(singles(w), pairs(w))).otherwise(singles(w)))


def slot_weights(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, broadcast_ids: int = BROADCAST_IDS) -> list[int]:
    """The weights, in millionths, of all slots: ``buckets`` numbers, whatever the input.

    Counts cover every document; add-one smoothing keeps empty slots finite. Ids in ``trusted``
    that are null or have no document count for nothing.
    """
    ids = trusted.select(F.col(key).alias("__id")).filter(F.col("__id").isNotNull()).distinct().withColumn("__trusted", F.lit(1))
    if ids.limit(broadcast_ids + 1).count() <= broadcast_ids:
        ids = F.broadcast(ids)
    grams = docs.join(ids, docs[key] == F.col("__id"), "left").select("__trusted", F.explode(slot_list(word_list(whole(text)), buckets)).alias("slot"))
    counts = grams.groupBy("slot").agg(F.count(F.lit(1)).alias("raw"), F.count("__trusted").alias("good"))
    all_slots = docs.sparkSession.range(buckets).withColumnRenamed("id", "slot").join(counts, "slot", "left").fillna(0, ["raw", "good"])
    one = all_slots.agg(F.sort_array(F.collect_list(F.struct("slot", "raw", "good"))).alias("s"), F.sum("raw").alias("raws"), F.sum("good").alias("goods"))
    share = lambda n, total: (n + 1) / (total + buckets)
    ratio = lambda x: F.round(F.log(share(x["good"], F.col("goods")) / share(x["raw"], F.col("raws"))) * UNIT).cast("long")
    return one.select(F.transform("s", ratio).alias("weights")).first().weights


def apply_rules(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS, **how) -> DataFrame:
    """``docs`` with the base figures, score and kept (columns of these names are replaced).

    A document is kept if no base rule fails it and its score reaches ``threshold``. A null or
    empty text has no words, fails the base and has a null score. Without trusted documents
    all weights are those of smoothing alone. Repeated rows are scored alike.
    """
    found = slot_weights(docs, trusted, key, text, buckets, **how)
    weights = F.split(F.lit(",".join(map(str, found))), ",").cast("array<bigint>")  # folded to one constant
    rated = with_base_rules(docs, text)
    total = F.aggregate(slot_list(F.col("__words"), buckets), F.lit(0).cast("long"), lambda a, s: a + F.get(weights, s))
    rated = rated.withColumn("score", F.when(F.col("n_words") > 0, total / (F.col("n_words") * 2 - 1) / UNIT))
    return rated.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).drop("__words")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the likelihood-ratio verdict of every document; documents labelled good are the target."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").filter("quality = 1")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    return apply_rules(docs, trusted).select(columns)
