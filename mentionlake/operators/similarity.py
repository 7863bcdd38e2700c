"""Near-duplicate titles and story clusters.

Titles are compared as sets of words: shared / max(size) must exceed a
threshold. The join is exact and avoids enumerating groups of copies:

1. Titles with the same word set collapse to one set before anything else.
2. Words are ordered by document frequency, rarest first. If two sets must share t words, the l-th
   word they share is among the first size - t + l of each, so their first l shared words are a key of both
   for any l up to t. Keys have one word, or two if the first is frequent.
3. In a key that few sets hold, all of them are compared. In a crowded one, every set is compared with the earliest
   (the leader); sets similar to it need no further comparison inside that key. If others remain, their pairs are
   compared where they are few beside the entries of longer keys; else the key is extended by every next word of its sets.
   Longer keys are kept, and extended in turn, only where they at least halve the pairs: in a key of sets that share
   a passage they would not, and their number would multiply round by round, so there the key's own pairs are compared.
   Sets that need no more shared words than the key has are similar to one another and are linked to the first of them.
4. Keys hold no words of their sets but 256 parity bits. A word that stands in one of two sets only turns one bit, so the bits that differ
   bound the shared words from above. Pairs that the bits, the sizes and the places of the key allow are made distinct, and only
   then compared on their words.
5. Longer keys cost disk, pairs only time: all rounds together write a bounded multiple of the first entries, and keys
   whose extension saves least are compared as they are.

The resulting links hold, for every set, its earliest similar set, and connect
the same components as the full similarity graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mentionlake.functions import dates as D, text as X
from mentionlake.operators.joins import skewed_lookup
from mentionlake.session import materialize

FREQUENT_WORD = 2000
SMALL_GROUP = 64
#: So many pairs cost less than one more entry, which is written, shuffled and grouped.
PAIRS_PER_ENTRY = 16
#: Entries of longer keys, in all rounds together, for each entry of the first round.
LONGER_PER_ENTRY = 2
#: Sets of a key that one task compares with all others of it.
BLOCK = 1000
#: Words of parity bits of a set, of 64 bits each.
BIT_WORDS = 4
_BITS = [f"bits{i}" for i in range(BIT_WORDS)]
_SLIM = ["a.sid as a", "b.sid as b", "b.ord as b_ord", "b.first_id as b_first"]
_UNDATED = -(2**62)


def _title_rows(articles: DataFrame) -> DataFrame:
    words = F.array_sort(X.title_words(F.coalesce("title", F.lit(""))))
    ordinal = F.coalesce(F.unix_micros("published_at"), F.lit(_UNDATED))
    return articles.select("id", ordinal.alias("ord"), words.alias("words")).filter(F.size("words") > 0).withColumn(
        "set_key", F.array_join("words", " ")
    )


def _word_sets(rows: DataFrame) -> DataFrame:
    """Distinct word sets: sid (smallest article id), earliest article, its date and the
    number of articles that share that date."""
    per_date = rows.groupBy("set_key", "ord").agg(F.min("id").alias("first_id"), F.min("id").alias("min_id"), F.count(F.lit(1)).alias("n_rows"))
    return per_date.groupBy("set_key").agg(
        F.min("min_id").alias("sid"),
        F.min(F.struct("ord", "first_id", "n_rows")).alias("first"),
        F.sum("n_rows").alias("members"),
    )


def _ordered_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """Words of each set as (frequency, word), rarest first, with their parity bits and the prefix length."""
    tokens = sets.select("sid", F.explode(F.split("set_key", " ")).alias("word"))
    frequency = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    place = F.xxhash64("word")
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    bits = [F.bit_xor(F.when(F.shiftright("place", 6).bitwiseAND(F.lit(BIT_WORDS - 1)) == i, bit).otherwise(F.lit(0).cast("bigint"))).alias(c) for i, c in enumerate(_BITS)]
    ordered = (
        skewed_lookup(tokens, frequency, "word").withColumn("place", place).groupBy("sid")
        .agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("ws"), *bits)
    )
    size = F.size("ws")
    return ordered.withColumns({"size": size, "prefix": size - _need(size, threshold) + 1}).filter(size >= 2)


def _need(size: Column, threshold: float) -> Column:
    """Similar sets share more than threshold * size words, so at least one more than the floor."""
    return F.floor(size * threshold + 1e-9).cast("int") + 1


def _entries(frequent: int) -> Column:
    """(key, at, depth) of one set: rare prefix words, or pairs that start with a frequent one; ``at`` is the place of the key's last word."""

    def entry(key: Column, at: Column, depth: int) -> Column:
        return F.struct(key.alias("key"), at.cast("int").alias("at"), F.lit(depth).alias("depth"))

    def of_position(i: Column) -> Column:
        first = F.element_at("ws", i)
        later = F.when(i <= F.col("prefix"), F.sequence(i + 1, F.col("prefix") + 1))
        pairs = F.transform(later, lambda j: entry(F.concat(first["word"], F.lit(" "), F.element_at("ws", j)["word"]), j, 2))
        return F.when(first["n"] > frequent, pairs).otherwise(F.array(entry(first["word"], i, 1)))

    return F.flatten(F.transform(F.sequence(F.lit(1), F.col("prefix")), of_position))


def _keys(frequent: int) -> Column:
    """The keys a set starts with."""
    return F.transform(_entries(frequent), lambda e: e["key"])


def _last_place(member: str, threshold: float) -> Column:
    """The last place where the next shared word can stand."""
    size = F.col(f"{member}.size")
    return F.least(size, size - _need(size, threshold) + F.col("depth") + 1)


def _extended(threshold: float, member: str = "m") -> Column:
    """(key, at, depth) one word longer: with every later word that can be the next shared one. ``words`` are the set's."""
    at, depth, last = F.col("at"), F.col("depth"), _last_place(member, threshold)
    places = F.when(at < last, F.sequence(at + 1, last))
    return F.transform(places, lambda q: F.struct(F.concat("key", F.lit(" "), F.element_at("words", q)).alias("key"), q.cast("int").alias("at"), (depth + 1).alias("depth")))


def _pairs(n: str, unled: str) -> Column:
    """Pairs of ``n`` sets, but for those of two sets that are similar to the leader."""
    u = F.col(unled)
    return u * (F.col(n) - u) + F.floor(u * (u - 1) / 2)


def _bits_allow(a: str, b: str, threshold: float) -> Column:
    """Sizes and parity bits of two sets leave room for enough shared words; holds for every similar pair."""
    m, n = F.col(f"{a}.size"), F.col(f"{b}.size")
    apart = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in _BITS), F.lit(0))
    return (F.least(m, n) > F.greatest(m, n) * threshold) & (m + n - apart >= 2 * _need(F.greatest(m, n), threshold))


def _places_allow(threshold: float) -> Column:
    """Enough words are left behind the key in both sets; holds for a similar pair in the key of its first shared words."""
    rest = F.least(F.col("a.size") - F.col("a_at"), F.col("b.size") - F.col("b_at"))
    return F.col("depth") + rest >= _need(F.greatest("a.size", "b.size"), threshold)


def _similar(a: Column, b: Column, threshold: float) -> Column:
    largest = F.greatest(F.size(a), F.size(b))
    close = F.least(F.size(a), F.size(b)) > largest * threshold
    return close & (F.size(F.array_intersect(a, b)) / largest > threshold)


def _verified(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """The distinct ``pairs`` (a, b, ...) of sets whose words are similar. A set may be the earlier one of very many pairs."""
    pairs = materialize(pairs.distinct(), "title-pairs")
    of = words.select("sid", F.col("ws.word").alias("words"))
    times = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    earlier = times.join(of.select(F.col("sid").alias("b"), F.col("words").alias("b_words")), "b")
    both = skewed_lookup(pairs.join(of.select(F.col("sid").alias("a"), F.col("words").alias("a_words")), "a"), earlier, "b")
    return both.filter(_similar(F.col("a_words"), F.col("b_words"), threshold)).select(*pairs.columns)


def _compared(entries: DataFrame, keys: DataFrame, threshold: float, most: int | None = None) -> DataFrame:
    """Pairs of sets of every key in ``keys`` (key, n) that may be similar. One side of a key of over ``BLOCK`` sets is dealt
    to blocks, the other stands in each; ``most`` is the largest n if it is known."""
    b_first = (F.col("b.ord") < F.col("a.ord")) | ((F.col("b.ord") == F.col("a.ord")) & (F.struct("b.first_id") < F.struct("a.first_id")))
    may = _bits_allow("a", "b", threshold) & _places_allow(threshold) & b_first & ~(F.col("a_led") & F.col("b_led"))

    def sides(listed: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
        a, b = ([F.col("m").alias(x), F.col("at").alias(f"{x}_at"), F.col("led").alias(f"{x}_led")] for x in "ab")
        return listed.select("key", *more, "depth", *a), listed.select("key", *more, *b)

    # On the key alone the sets need no second exchange.
    a, b = sides(entries.join(keys.filter(F.col("n") <= BLOCK).select("key"), "key"))
    met = a.join(b, "key").filter(may).selectExpr(*_SLIM)
    if most is not None and most <= BLOCK:
        return met
    blocks = keys.filter(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    large = entries.join(blocks, "key")
    one = F.pmod(F.xxhash64("m.sid"), F.col("blocks")).cast("int")
    a, _ = sides(large.withColumn("block", one), "block")
    _, b = sides(large.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), "block")
    return met.unionByName(a.join(b, ["key", "block"]).filter(may).selectExpr(*_SLIM))


def _least_gain(rest: DataFrame, allowed: int) -> int:
    """Pairs per longer entry from which keys are extended, so that the longer entries are ``allowed`` at most."""
    gain = F.floor(F.log2(F.col("pairs") / F.greatest("longer", F.lit(1)))).cast("int")
    by_gain = {r["gain"]: r["longer"] for r in rest.groupBy(gain.alias("gain")).agg(F.sum("longer").alias("longer")).collect()}
    least = PAIRS_PER_ENTRY.bit_length() - 1
    while sum(n for g, n in by_gain.items() if g >= least) > allowed:
        least += 1
    return 1 << least


def set_links(
    sets: DataFrame, threshold: float, same_date: bool = False, frequent: int = FREQUENT_WORD, small: int = SMALL_GROUP, trace: list | None = None
) -> DataFrame:
    """Links (a later, b earlier) between similar word sets; see the module text.

    ``sets``: sid, ord, first_id, set_key. ``same_date`` restricts comparisons to
    sets whose earliest article has the same date. ``trace`` receives, per round, the numbers of
    entries and of pairs that meet.
    """
    if threshold < 0.5:
        raise ValueError("the prefix filter needs a threshold of at least 0.5")
    dated = sets.select("sid", "ord", "first_id")
    words = materialize(_ordered_sets(sets, threshold).join(dated, "sid"), "title-words")
    member = F.struct("ord", "first_id", "sid", "size", *_BITS)
    entries = words.select(member.alias("m"), F.explode(_entries(frequent)).alias("e"), F.lit(False).alias("led"))
    if same_date:
        entries = entries.withColumn("e", F.struct(F.concat_ws("@", "e.key", "m.ord").alias("key"), "e.at", "e.depth"))
    entries = entries.withColumn("parent", F.lit(None).cast("string"))
    fields = ["m", "key", "at", "depth", "led"]
    pairs: list[DataFrame] = []
    tried = allowed = None  # the entries of the keys that ``entries`` extends, with their numbers of sets and pairs; how many longer entries may follow
    while True:
        entries = materialize(entries.select("m", "e.*", "led", "parent"), "title-entries")
        n, unled = F.count(F.lit(1)), F.count(F.when(~F.col("led"), 1))
        groups = entries.groupBy("key").agg(n.alias("n"), unled.alias("unled"), F.min("parent").alias("parent"))
        groups = materialize(groups.filter("n > 1 and unled > 0"), "title-groups")
        few = groups.filter(F.col("n") <= small).select("key", "parent", "n", _pairs("n", "unled").alias("pairs"), F.lit(0).cast("bigint").alias("longer"))

        due, crowded = few, groups.filter(F.col("n") > small).limit(1).count() > 0
        if crowded:
            large = groups.filter(F.col("n") > small).select("key", "n")
            held = materialize(skewed_lookup(entries, large, "key"), "title-held")
            closed = F.when(_need(F.col("m.size"), threshold) <= F.col("depth"), F.col("m"))
            heads = held.groupBy("key").agg(F.min("m").alias("lead"), F.min(closed).alias("closed"), n.alias("n"))
            near = (F.col("m.sid") != F.col("lead.sid")) & _bits_allow("m", "lead", threshold)
            crowd = materialize(skewed_lookup(held.drop("n"), heads, "key").withColumn("near", near), "title-crowds")
            to_closed = crowd.withColumn("b", F.col("closed")).filter(closed.isNotNull() & (F.col("m.sid") != F.col("b.sid")))
            pairs.append(to_closed.withColumn("a", F.col("m")).selectExpr(*_SLIM))
            to_lead = crowd.filter("near").select(F.col("m").alias("a"), F.col("lead").alias("b")).selectExpr(*_SLIM)
            to_lead = materialize(_verified(to_lead, words, threshold), "title-led")
            pairs.append(to_lead)
            like = to_lead.select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.lit(True).alias("like")).distinct()
            alike = crowd.filter("near").join(like, (F.col("m.sid") == F.col("__a")) & (F.col("lead.sid") == F.col("__b")), "left")
            alike = alike.withColumn("led", F.coalesce("like", F.lit(False))).select(*fields, "parent")
            crowd = alike.unionByName(crowd.filter(~F.col("near")).withColumn("led", F.col("m.sid") == F.col("lead.sid")).select(*fields, "parent"))
            # A key whose sets are all similar to the leader is done.
            longer = F.sum(F.greatest(_last_place("m", threshold) - F.col("at"), F.lit(0)))
            left = crowd.groupBy("key").agg(F.min("parent").alias("parent"), n.alias("n"), unled.alias("unled"), longer.cast("bigint").alias("longer"))
            left = left.filter("unled > 0").select("key", "parent", "n", _pairs("n", "unled").alias("pairs"), "longer")
            due = materialize(few.unionByName(left), "title-costs")

        # Longer keys count only where they halve the pairs of the key they extend; elsewhere its own pairs are compared.
        if tried is not None:
            own = tried.groupBy("key").agg(F.max("pairs").alias("own"), F.max("n").alias("n"))
            below = due.groupBy("parent").agg(F.sum("pairs").alias("below")).withColumnRenamed("parent", "key")
            vain = own.join(below, "key").filter(2 * F.col("below") > F.col("own")).select("key", "n", F.col("own").alias("pairs"))
            vain = materialize(vain, "title-vain")
            if vain.limit(1).count() > 0:
                pairs.append(_compared(tried.select(*fields), vain, threshold))
                due = due.join(vain.select(F.col("key").alias("parent")), "parent", "left_anti")
        gain = PAIRS_PER_ENTRY
        if crowded:
            made = entries.count()
            allowed = LONGER_PER_ENTRY * made if allowed is None else allowed - made
            gain = _least_gain(due.filter((F.col("n") > small) & (F.col("pairs") > gain * F.col("longer"))), max(allowed, 0))
        now = (F.col("n") <= small) | (F.col("pairs") <= gain * F.col("longer"))
        if trace is not None:
            met = due.filter(now).agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
            if tried is not None:
                met += vain.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
            trace.append((entries.count(), int(met)))
        pairs.append(_compared(entries.select(*fields), due.filter(F.col("n") <= small), threshold, most=small))
        if not crowded:
            break
        pairs.append(_compared(crowd, due.filter(now & (F.col("n") > small)), threshold))
        rest = due.filter(~now).select("key", "n", "pairs")
        if rest.limit(1).count() == 0:
            break
        tried = materialize(skewed_lookup(crowd.select(*fields), rest, "key", "pairs"), "title-tried")
        at_words = tried.join(words.select(F.col("sid").alias("__sid"), F.col("ws.word").alias("words")), F.col("m.sid") == F.col("__sid"))
        entries = at_words.select("m", F.explode(_extended(threshold)).alias("e"), "led", F.col("key").alias("parent"))
    out = pairs[0]
    for more in pairs[1:]:
        out = out.unionByName(more)
    return _verified(out, words, threshold)


def near_duplicates(
    articles: DataFrame, as_of=None, window_days: int | None = 7, threshold: float = 0.65, compat: bool = False, **tuning
) -> DataFrame:
    """(id, is_duplicate, duplicate_of) for the articles of the window.

    An article is a duplicate when a similar title was published before it
    (ties by id); ``duplicate_of`` is the earliest such article. ``compat``
    repeats the date-only tie rule: equal-dated twins flag each other.
    """
    if window_days is not None:
        articles = articles.filter(F.col("published_at") >= D.days_before(as_of, window_days))
    rows = _title_rows(articles)
    sets = _word_sets(rows).select("set_key", "sid", "first.ord", "first.first_id", F.col("first.n_rows").alias("n_first"))
    sets = materialize(sets, "title-sets")
    links = set_links(sets, threshold, **tuning)
    earliest = links.groupBy(F.col("a").alias("sid")).agg(F.min(F.struct("b_ord", "b_first")).alias("other"))
    keep = sets.join(earliest, "sid", "left").select(
        "set_key", "ord", "first_id", "n_first",
        F.when(F.col("other").isNull(), F.struct(F.col("ord").alias("o"), F.col("first_id").alias("i")))
        .otherwise(F.struct(F.col("other.b_ord").alias("o"), F.col("other.b_first").alias("i")))
        .alias("head"),
        "sid",
    )
    twin = F.lit(False)
    if compat:
        same = set_links(sets, threshold, same_date=True, **tuning)
        flagged = same.select(F.col("a").alias("sid")).unionByName(same.select(F.col("b").alias("sid"))).distinct()
        keep = keep.join(flagged.withColumn("twin", F.lit(True)), "sid", "left")
        twin = F.coalesce("twin", F.lit(False)) | (F.col("n_first") > 1)
    heads = keep.select("set_key", "head.i", F.col("first_id").alias("set_first"), twin.alias("twin"))
    # One row per set on the right: AQE splits the partition of a very large set.
    member = rows.select("id", "set_key").join(heads, "set_key")
    dup = (F.col("i") != F.col("id")) | (F.col("twin") & (F.col("id") == F.col("set_first")))
    flags = member.select(
        "id", dup.alias("is_duplicate"), F.when(F.col("i") != F.col("id"), F.col("i")).alias("duplicate_of")
    )
    return articles.select("id").join(flags, "id", "left").select(
        "id", F.coalesce("is_duplicate", F.lit(False)).alias("is_duplicate"), "duplicate_of"
    )


def mark_duplicates(articles: DataFrame, flags: DataFrame) -> DataFrame:
    """Write the outcome of ``near_duplicates`` onto the fact; earlier flags stay."""
    new = flags.select("id", F.col("is_duplicate").alias("__dup"), F.col("duplicate_of").alias("__of"))
    return articles.join(new, "id", "left").select(
        *[c for c in articles.columns if c not in ("is_duplicate", "duplicate_of")],
        F.coalesce("__dup", "is_duplicate").alias("is_duplicate"),
        (F.coalesce("__of", "duplicate_of") if "duplicate_of" in articles.columns else F.col("__of")).alias("duplicate_of"),
    )


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) with the smallest node as component, by alternating
    large-star and small-star contractions. Each round is written out; the
    driver sees two numbers per round."""
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    current = materialize(pairs, "edges")
    nodes = current.select(F.col("u").alias("node")).unionByName(current.select(F.col("v").alias("node"))).distinct()
    before = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        current = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = current.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (state.n, state.x) == before:
            break
        before = (state.n, state.x)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(current.withColumnRenamed("u", "node"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("component")
    )


def cluster_stories(
    articles: DataFrame, as_of=None, window_days: int | None = 7, threshold: float = 0.5, time_column: str = "fetched_at", **tuning
) -> DataFrame:
    """(id, story_cluster_id) of articles that tell the same story; single
    articles are left out. Only unclustered rows of the window take part. The
    cluster id is the smallest article id in it."""
    if "story_cluster_id" in articles.columns:
        articles = articles.filter(F.col("story_cluster_id").isNull())
    if window_days is not None:
        articles = articles.filter(F.col(time_column) >= D.days_before(as_of, window_days))
    rows = _title_rows(articles)
    sets = materialize(_word_sets(rows).select("set_key", "sid", "first.ord", "first.first_id", "members"), "title-sets")
    parts = connected_components(set_links(sets, threshold, **tuning).select("a", "b"))
    labelled = sets.join(parts.withColumnRenamed("node", "sid"), "sid", "left").filter(
        F.col("component").isNotNull() | (F.col("members") > 1)
    )
    labels = labelled.select("set_key", F.coalesce("component", "sid").alias("story_cluster_id"))
    return rows.select("id", "set_key").join(labels, "set_key").select("id", "story_cluster_id")
