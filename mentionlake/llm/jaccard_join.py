"""N-gram Jaccard join (operator 10): size-aware, heavy and light.

A document's set holds its distinct 4-word shingles, as 64-bit hashes. Equal sets are one set
from the start. Two sets link if their Jaccard similarity reaches ``percent`` per cent.

* Light sets (up to ``boundary`` shingles) emit every subset that is large enough to be the
  required overlap with some partner; sharing a subset of c elements proves an overlap of c,
  so no text is read again. In each list every member is compared with the smallest one: if two
  members may link at all, both link to it, so components lose nothing and no pairs are made.
* Heavy sets stand in the inverted lists of their first (rarest) shingles, as many as the
  similarity leaves room to differ. Lists with the same members are one list. Lists are scanned in rounds: first every member meets the
  list's most connected member; verified links then tell which lists still hold sets that are
  not connected, and of such pairs only those are tried that the sets' bitmaps allow.
* The boundary is where the total cost, from the sizes' histogram and the measured share of
  shingles that recur, is least.

Rarity comes from exact counts over all documents; the ``hot`` most frequent shingles are
broadcast (a fixed number of 4-byte prefixes). Any common order gives the same links: the counts
only decide how long lists get.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.llm.common import discard, ship, small_batches, table, whole
from mentionlake.operators.similarity import connected_components
from mentionlake.session import materialize

WIDTH = 4
PERCENT = 85
HOT = 1 << 18
#: Ids of sets in candidate pairs are broadcast up to this many (8 bytes each); beyond it the join shuffles.
BROADCAST_SETS = 2_000_000
#: What fetching and comparing a candidate costs, in list rows; for the boundary only.
CHECK_COST = 50
LARGEST_LIGHT = 32
#: Cross pairs per list row beyond which another round of leaders goes first.
CROWDED = 20
#: 64-bit words of a set's bitmap.
BITMAP_WORDS = 16
WORDS = [f"w{i}" for i in range(BITMAP_WORDS)]
#: Keys of a set's lists that its rows carry, so that a pair is made in one of its common lists; any number gives the same pairs.
FIRST_KEYS = 8
FLUSH_TOKENS = 1_000_000
#: What a task hands on at once: list rows (25 bytes each), bytes of tokens. Larger batches stay in the executor's direct memory.
FLUSH_ROWS = 100_000
FLUSH_BYTES = 2_000_000
WORDS_KEPT = 150_000
#: Rows of text that go to a Python worker at once.
BATCH_ROWS = 2_000
ONE = np.ones(1, bool)
M1, M2, P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of the words a task has met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


class Shingler:
    """Sets of shingle hashes; remembers word hashes within a task."""

    def __init__(self, width: int = WIDTH):
        self.width = width
        self.known = WordHashes()

    def tokens(self, text: str) -> np.ndarray:
        """Sorted distinct hashes: of ``width`` consecutive words, or of all words if there are fewer."""
        words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space separates
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        hashes = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        if not len(words):
            return hashes
        width = min(self.width, len(words))
        n = len(words) - width + 1
        total = hashes[:n] + np.uint64(width)
        for i in range(1, width):
            total *= P
            total += hashes[i : n + i]
        total = mix(total)
        total.sort()
        return total[np.concatenate((ONE, total[1:] != total[:-1]))]


def set_id(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def least_overlap(a, b, percent: int = PERCENT):
    """Smallest overlap that links sets of these sizes; numbers or Columns' integer arithmetic."""
    return (percent * (a + b) + percent + 99) // (100 + percent)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


def _distinct_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(set_id, tokens) of each set a task meets for the first time, nothing for empty ones."""
    make, seen = Shingler(width), set()
    for batch in batches:
        for text in batch.column(0):
            tokens = make.tokens(text.as_py())
            if len(tokens) and (key := set_id(tokens)) not in seen:
                seen.add(key)
                yield key, tokens


NAMES = ["size", "set_id", "part", "steps", "counts"]
DESCRIBED = "size int, set_id long, part int, steps binary, counts binary"


def _describe(width: int, bits: int):
    """Two kinds of rows from one reading of the texts: each document with its set's size and id, and
    counts of the 4-byte prefixes of the task's sets, sorted, cut into 2**bits ranges, as compressed differences."""

    def parts(held: list[np.ndarray], like: pa.Schema) -> pa.RecordBatch:
        values = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.concatenate((ONE, values[1:] != values[:-1])))
        values, counts = values[first], np.diff(first, append=len(values)).astype(np.uint32)
        cuts = np.searchsorted(values, (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(32 - bits)).astype(np.uint32))
        pack = zstandard.ZstdCompressor(level=1).compress
        rows = [
            (k, pack(np.diff(v, prepend=np.uint32(0)).tobytes()), pack(n.tobytes()))
            for k, (v, n) in enumerate(zip(np.split(values, cuts), np.split(counts, cuts), strict=True))
            if len(v)
        ]
        own = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))]
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(rows), f.type) for f in like), pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.int64()), *own], [*like.names, *NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen, held, n, like = Shingler(width), set(), [], 0, None
        for batch in batches:
            kept = batch.select([c for c in batch.schema.names if c != "__text"])
            like, sizes, ids = kept.schema, [], []
            for text in batch.column("__text"):
                tokens = make.tokens(text.as_py())
                sizes.append(len(tokens))
                ids.append(set_id(tokens) if len(tokens) else None)
                if len(tokens) and ids[-1] not in seen:
                    seen.add(ids[-1])
                    held.append((tokens >> np.uint64(32)).astype(np.uint32))
                    n += len(tokens)
                    if n > FLUSH_TOKENS:
                        yield parts(held, like)
                        held, n = [], 0
            rest = [pa.nulls(len(sizes), t) for t in (pa.int32(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sizes, pa.int32()), pa.array(ids, pa.int64()), *rest], [*like.names, *NAMES])
        if held:
            yield parts(held, like)

    return run


def _sum_counts(least: int):
    def run(group: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        values = [np.cumsum(np.frombuffer(unpack(x), np.uint32), dtype=np.uint32) for x in group.column("steps").to_pylist()]
        counts = [np.frombuffer(unpack(x), np.uint32) for x in group.column("counts").to_pylist()]
        both = np.sort(np.concatenate([v.astype(np.uint64) << np.uint64(32) | n for v, n in zip(values, counts, strict=True)]))
        value, count = both >> np.uint64(32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate((ONE, value[1:] != value[:-1])))
        value, count = value[first], np.add.reduceat(count, first)
        often = count >= least
        token = [None, *value[often].tolist()]
        shared = [int(count[count > 1].sum())] + [None] * int(often.sum())
        return pa.table({"token": pa.array(token, pa.int64()), "n": pa.array([int(count.sum()), *count[often].tolist()], pa.int64()), "shared": pa.array(shared, pa.int64())})

    return run


def frequent_tokens(described: DataFrame, hot: int, least: int = 6) -> tuple[np.ndarray, float]:
    """(4-byte prefixes of the most frequent shingles, rarest first; share of shingles that recur).

    Counts are exact over all distinct sets of each task. They move as compressed differences in
    ranges whose number grows with the input, so no task holds more than about a million.
    """
    parts = described.filter("part IS NOT NULL").select("part", "steps", "counts")
    counts = materialize(parts.groupBy("part").applyInArrow(_sum_counts(least), "token long, n long, shared long"), "shingle-counts")
    seen = counts.filter("token IS NULL").agg(F.sum("n"), F.sum("shared")).first()
    top = counts.filter("token IS NOT NULL").orderBy(F.desc("n"), "token").limit(hot).select("token").toArrow()
    return top.column(0).to_numpy().astype(np.uint32)[::-1], (seen[1] or 0) / max(1, seen[0] or 0)


def describe(docs: DataFrame, text: str, width: int = WIDTH) -> DataFrame:
    """The columns of ``docs`` but for the text, with DESCRIBED columns, in the shared folder; see ``_describe``."""
    size = docs.agg(F.sum(F.octet_length(whole(text)))).first()[0] or 0
    bits = max(4, min(24, int(np.ceil(np.log2(size / 6 / 500_000 + 1)))))
    kept = docs.drop(text, *NAMES)
    inner = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    rows = docs.select(*[F.col(f"`{c}`") for c in kept.columns], whole(text).alias("__text"))
    return materialize(rows.mapInArrow(_describe(width, bits), f"{inner}{', ' if inner else ''}{DESCRIBED}"), "sets")


def choose_boundary(sizes: dict[int, int], recur: float, percent: int = PERCENT) -> int:
    """The largest light size: least total of subset rows below, list rows and expected checks above."""
    light = lambda n: sum(comb(n, j) for j in range(n - (percent * n + 99) // 100 + 1))
    heavy = lambda n: prefix_length(n, percent) * (1 + CHECK_COST * recur)

    def cost(b: int) -> float:
        both = sum(k * prefix_length(n, percent) for n, k in sizes.items() if percent * (b + 1) <= 100 * n <= 100 * b)
        return both + sum(k * (light(n) if n <= b else heavy(n)) for n, k in sizes.items() if n <= LARGEST_LIGHT)

    return min(range(1, LARGEST_LIGHT + 1), key=lambda b: (cost(b), b))


def _list_rows(width: int, percent: int, boundary: int, hot):
    """Rows (key, set_id, size, pos, light): of subsets, with pos the subset's size, or of inverted lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarest_first = hot.value
        order = np.argsort(rarest_first)
        hot_sorted = rarest_first[order]
        keys, ids, sizes, places, kinds, held = [], [], [], [], [], 0

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (keys, ids, sizes, places, kinds)], ["key", "set_id", "size", "pos", "light"]
            )
            for x in (keys, ids, sizes, places, kinds):
                x.clear()
            return out

        def put(key: np.ndarray, owner: int, size: int, pos: np.ndarray, light: bool) -> None:
            nonlocal held
            held += len(key)
            keys.append(key.view(np.int64))
            ids.append(np.full(len(key), owner, np.int64))
            sizes.append(np.full(len(key), size, np.int32))
            places.append(pos.astype(np.int32))
            kinds.append(np.full(len(key), light))

        for owner, tokens in _distinct_sets(batches, width):
            n = len(tokens)
            if n <= boundary:
                parts = mix(tokens)
                total = parts.sum(dtype=np.uint64)
                for dropped in range(n - (percent * n + 99) // 100 + 1):
                    gone = np.array([parts[list(c)].sum(dtype=np.uint64) for c in combinations(range(n), dropped)], np.uint64)
                    put(mix(total - gone + np.uint64((n - dropped) * int(P) % (1 << 64))), owner, n, np.full(len(gone), n - dropped), True)
            if n > boundary or 100 * n >= percent * (boundary + 1):
                rank = np.zeros(n, np.int64)
                if len(hot_sorted):
                    short = (tokens >> np.uint64(32)).astype(np.uint32)
                    slot = np.minimum(np.searchsorted(hot_sorted, short), len(hot_sorted) - 1)
                    rank = np.where(hot_sorted[slot] == short, order[slot] + 1, 0)
                first = tokens[np.lexsort((tokens, rank))][: prefix_length(n, percent)]
                put(first, owner, n, np.arange(len(first)), False)
            if held > FLUSH_ROWS:
                yield batch()
                held = 0
        if keys:
            yield batch()

    return run


def _narrow(sets: DataFrame, ids: DataFrame, limit: int) -> DataFrame:
    """The rows of ``sets`` whose set_id is in ``ids``: by broadcast if these are few, else by shuffle."""
    few = ids.limit(limit + 1).count() <= limit
    return sets.join(F.broadcast(ids) if few else ids, "set_id", "left_semi")


def _bitmaps(sets: DataFrame) -> DataFrame:
    """(set_id, size, bits, w0..): a bitmap of each set's shingles, by a part of their hashes, and its number of ones."""
    fields = ",".join(f"w{i}:long" for i in range(BITMAP_WORDS))

    @F.arrow_udf(f"struct<size:int,bits:int,{fields}>")
    def draw(column: pa.Array) -> pa.Array:
        sizes, rows = [], np.zeros((len(column), BITMAP_WORDS * 64), bool)
        for i, x in enumerate(column):
            tokens = np.frombuffer(x.as_buffer(), np.uint64)
            sizes.append(len(tokens))
            rows[i, (tokens >> np.uint64(32)) % np.uint64(BITMAP_WORDS * 64)] = True
        words = np.packbits(rows, axis=1).view(np.int64).reshape(len(column), BITMAP_WORDS)
        drawn = [pa.array(np.ascontiguousarray(words[:, i])) for i in range(BITMAP_WORDS)]
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.array(rows.sum(1), pa.int32()), *drawn], ["size", "bits", *WORDS])

    return sets.select("set_id", draw("tokens").alias("m")).select("set_id", "m.*")


def _may_overlap(a: str, b: str, percent: int) -> Column:
    """Whether two sets can be similar by their bitmaps: a bit of one that the other lacks is a shingle it lacks."""
    both = " + ".join(f"bit_count({a}.{w} & {b}.{w})" for w in WORDS)
    need = f"({percent} * ({a}.size + {b}.size) + {percent} + 99) DIV (100 + {percent})"
    return F.expr(f"least({a}.size - {a}.bits, {b}.size - {b}.bits) + {both} >= {need}")


def _verify(pairs: DataFrame, sets: DataFrame, bitmaps: DataFrame, percent: int, broadcast_sets: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: bitmaps rule most others out before all shingles are compared."""
    side = lambda name: bitmaps.select(F.col("set_id").alias(name), F.struct("size", "bits", *WORDS).alias(f"m{name}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").filter(_may_overlap("ma", "mb", percent)).select("a", "b")
    pairs = materialize(pairs, "set-pairs")
    used = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    held = _narrow(sets, used, broadcast_sets)

    @F.arrow_udf("boolean")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right, strict=True):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * both >= percent * (len(a) + len(b) - both))
        return pa.array(out, pa.bool_())

    right = pairs.join(held.withColumnsRenamed({"set_id": "b", "tokens": "tokens_b"}), "b")
    joined = right.join(held.withColumnsRenamed({"set_id": "a", "tokens": "tokens_a"}), "a")
    return materialize(joined.filter(similar("tokens_a", "tokens_b")).select("a", "b"), "set-links")


def _may_link(a: str, b: str, percent: int, boundary: int) -> Column:
    """Whether two rows of an inverted list can belong to similar sets, by sizes and places in the common order."""
    size = lambda s: F.col(f"{s}.size")
    pos = lambda s: F.col(f"{s}.pos")
    need = F.expr(f"({percent} * ({a}.size + {b}.size) + {percent} + 99) DIV (100 + {percent})")
    room = F.least(pos(a), pos(b)) + F.least(size(a) - pos(a), size(b) - pos(b))
    ratio = F.least(size(a), size(b)) * 100 >= F.greatest(size(a), size(b)) * percent
    return ratio & (room >= need) & (F.greatest(size(a), size(b)) > boundary)


def _ordered(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(f"{a}.set_id", f"{b}.set_id").alias("a"), F.greatest(f"{a}.set_id", f"{b}.set_id").alias("b"))


def _light_links(lists: DataFrame, percent: int) -> DataFrame:
    """Links of light sets: each member of a subset's list with the list's smallest set."""
    rows = lists.filter("light")
    lead = rows.groupBy("key").agg(F.min(F.struct("size", "set_id")).alias("l"))
    met = rows.join(lead, "key").filter(F.col("set_id") != F.col("l.set_id"))
    met = met.filter(F.col("pos") * 100 >= (F.col("size") + F.col("l.size") - F.col("pos")) * percent)
    return met.select(F.least("set_id", "l.set_id").alias("a"), F.greatest("set_id", "l.set_id").alias("b")).distinct()


def _star_pairs(rows: DataFrame, rank: Column, percent: int, boundary: int) -> DataFrame:
    """Pairs of each row with its list's leader, the row of greatest ``rank``; rows hold key, set_id, size, pos, component."""
    me = F.struct("set_id", "size", "pos", "component")
    lead = rows.withColumn("__rank", rank).groupBy("key").agg(F.max(F.struct("__rank", me.alias("m")))["m"].alias("l"))
    met = rows.select("key", me.alias("r")).join(lead, "key").filter((F.col("r.component") != F.col("l.component")) & _may_link("r", "l", percent, boundary))
    return _ordered(met, "r", "l").distinct()


def _list_lengths(heavy: DataFrame) -> DataFrame:
    """(key, n, x, y): length and 128-bit fingerprint of each list's members."""
    marks = [F.bit_xor(F.xxhash64("set_id", F.lit(seed))).alias(name) for seed, name in enumerate("xy")]
    return heavy.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *marks)


def _different_lists(lengths: DataFrame) -> DataFrame:
    """One key of all lists with the same members: a passage that some sets share stands in a list for each of its
    shingles. ``_may_link`` holds for similar sets at whatever shingle they share, so one of these lists is enough."""
    return lengths.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")


def _cross_pairs(rows: DataFrame, bitmaps: DataFrame, percent: int, boundary: int) -> DataFrame:
    """Pairs of unconnected sets of one list that may be similar by places and by bitmaps, so that unlike sets of a
    list are never rows; rows hold key, set_id, size, pos, component. A list leaves a pair out if a smaller key is among
    the first of both sets: the smallest key that they share never does."""
    first = rows.groupBy("set_id").agg(F.slice(F.sort_array(F.collect_list("key")), 1, FIRST_KEYS).alias("first"))
    drawn = rows.join(first, "set_id").join(bitmaps.drop("size"), "set_id")
    side = lambda s: drawn.select(F.col("key").alias(f"{s}_key"), F.struct("set_id", "size", "pos", "component", "first", "bits", *WORDS).alias(s))
    test = (F.col("p.set_id") < F.col("q.set_id")) & (F.col("p.component") != F.col("q.component")) & _may_link("p", "q", percent, boundary)
    here = F.coalesce(F.array_min(F.array_intersect("p.first", "q.first")) >= F.col("p_key"), F.lit(True))
    return _ordered(side("p").join(side("q"), (F.col("p_key") == F.col("q_key")) & test & _may_overlap("p", "q", percent) & here), "p", "q")


def _hubs(links: DataFrame) -> DataFrame:
    """(set_id, component): the best connected set among each linked set and its neighbours. Sets with one
    hub are connected, which is all that the choice of further pairs needs; it takes one pass, not rounds."""
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct()
    degree = both.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    ranked = both.join(degree.withColumnRenamed("x", "y"), "y").select("x", "n", "y").unionByName(degree.select("x", "n", F.col("x").alias("y")))
    return ranked.groupBy("x").agg(F.max(F.struct("n", "y"))["y"].alias("component")).withColumnRenamed("x", "set_id")


def similar_sets(
    docs: DataFrame, text: str = "text", width: int = WIDTH, percent: int = PERCENT, hot: int = HOT, boundary: int | None = None,
    crowded: int = CROWDED, broadcast_sets: int = BROADCAST_SETS,
) -> tuple[DataFrame, DataFrame]:
    """(documents with size and set_id, (node, component) of the sets that link to others).

    A null or empty text has an empty set and links with nothing. Repeated rows share a set.
    """
    if percent < 50:
        raise ValueError("the list lengths assume a similarity of at least one half")
    with small_batches(ship(docs.sparkSession), BATCH_ROWS):
        return _similar_sets(docs, text, width, percent, hot, boundary, crowded, broadcast_sets)


def _similar_sets(
    docs: DataFrame, text: str, width: int, percent: int, hot: int, boundary: int | None, crowded: int, broadcast_sets: int
) -> tuple[DataFrame, DataFrame]:
    texts = docs.select(whole(text).alias("text"))
    described = describe(docs, text, width)
    slim = materialize(described.filter("part IS NULL").drop("part", "steps", "counts"), "slim-sets")
    common, recur = frequent_tokens(described, hot)
    discard(described)
    if boundary is None:
        distinct = slim.filter("size > 0").select("set_id", "size").distinct()
        sizes = distinct.filter(F.col("size") <= LARGEST_LIGHT).groupBy("size").count().collect()
        boundary = choose_boundary({r[0]: r[1] for r in sizes}, recur, percent)
    held = docs.sparkSession.sparkContext.broadcast(common)
    rows = texts.mapInArrow(_list_rows(width, percent, boundary, held), "key long, set_id long, size int, pos int, light boolean")
    rows = materialize(rows, "set-lists")
    shared = rows.groupBy("key").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).filter("low <> high")
    lists = materialize(rows.join(shared.select("key"), "key").distinct(), "shared-lists")
    discard(rows)

    links = materialize(_light_links(lists, percent), "light-links")
    heavy = lists.filter("NOT light").select("key", "set_id", "size", "pos")
    sets = materialize(_tokens_of(texts, heavy.select("set_id").distinct(), width), "set-tokens")
    lengths = materialize(_list_lengths(heavy), "list-lengths")
    weight = heavy.join(lengths, "key").groupBy("set_id").agg(F.sum("n").alias("weight"))
    heavy = materialize(heavy.join(_different_lists(lengths), "key", "left_semi").join(weight, "set_id"), "heavy-lists")
    bitmaps = materialize(_bitmaps(sets), "set-bitmaps")
    tested = None
    for turn in range(3):
        if turn:
            labelled = heavy.join(_hubs(links), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
        else:
            labelled = heavy.withColumn("component", F.col("set_id"))
        mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).filter("low <> high")
        open_rows = labelled.join(mixed.select("key", "n"), "key")
        if turn:
            open_rows = materialize(open_rows, "open-lists")
            by_part = open_rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
            load = by_part.groupBy("key").agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("x"), F.sum("n").alias("n")).agg(F.sum("x"), F.sum("n")).first()
            last = turn == 2 or (load[0] or 0) <= 2 * crowded * (load[1] or 0)
        else:
            last = False
        if last:
            pairs = _cross_pairs(open_rows, bitmaps, percent, boundary).distinct()
        else:
            pairs = _star_pairs(open_rows, F.col("weight") if not turn else F.xxhash64("set_id", F.lit(turn)), percent, boundary)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "candidates")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = links.unionByName(_verify(pairs, sets, bitmaps, percent, broadcast_sets))
        if last:
            break
    for used in (lists, lengths, heavy, sets, bitmaps):  # the links are written
        discard(used)
    return slim, connected_components(links)


def _tokens_of(texts: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(set_id, tokens binary), one row for each set in ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for key, tokens in _distinct_sets(batches, width):
            out.append((key, tokens.tobytes()))
            size += 8 * len(tokens)
            if size > FLUSH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([t for _, t in out], pa.binary())], ["set_id", "tokens"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([t for _, t in out], pa.binary())], ["set_id", "tokens"])

    return texts.mapInArrow(run, "set_id long, tokens binary").join(ids.hint("merge"), "set_id", "left_semi").dropDuplicates(["set_id"])


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(``key``, n_shingles, component_id): one row per row of ``docs``; the component is the smallest
    key reachable by links. Null keys take part but are never a component's name unless all are null."""
    slim, parts = similar_sets(docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")), "__text", **how)
    named = slim.join(parts.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("part", F.coalesce("component", "set_id"))
    lowest = named.filter("part IS NOT NULL").groupBy("part").agg(F.min("__key").alias("low"))
    out = named.join(lowest, "part", "left")
    return out.select(F.col("__key").alias(key), F.col("size").cast("long").alias("n_shingles"), F.when(F.col("size") > 0, F.col("low")).otherwise(F.col("__key")).alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", broadcast_rows: int = BROADCAST_SETS // 4, **how) -> DataFrame:
    """``docs`` without near duplicates: of each component the row with the smallest key stays, of equal
    keys the one with the smallest text hash, of wholly repeated (key, text) one. Null keys come last.
    Rows without words link with nothing and stay.
    """
    named = docs.select(F.col(key).alias("__key"), F.xxhash64(whole(text)).alias("__hash"), F.col(text).alias("__text"))
    slim, parts = similar_sets(named, "__text", **how)
    rows = slim.filter("size > 0").join(parts.withColumnRenamed("node", "set_id"), "set_id", "left")
    rows = rows.select(F.coalesce("component", "set_id").alias("part"), F.struct(F.col("__key").isNull(), "__key", "__hash").alias("row"))
    first = rows.groupBy("part").agg(F.min("row").alias("first"))
    rows = materialize(rows.join(first, "part").select(F.col("row.__key").alias("__key"), F.col("row.__hash").alias("__hash"), (F.col("row") == F.col("first")).alias("stays")), "near-copies")
    gone = rows.filter("NOT stays").select("__key", "__hash").distinct()
    few = gone.limit(broadcast_rows + 1).count() <= broadcast_rows
    same = docs[key].eqNullSafe(F.col("__key")) & (F.xxhash64(whole(docs[text])) == F.col("__hash"))
    left = docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
    repeated = rows.filter("stays").groupBy("__key", "__hash").count().filter("count > 1").limit(1).count()
    if repeated:  # rows without words are no copies of each other
        wordless = whole(text).rlike(r"^[\x20\x09-\x0D]*$")
        left = left.filter(~wordless).withColumn("__hash", F.xxhash64(whole(text))).dropDuplicates([key, "__hash"]).drop("__hash").unionByName(left.filter(wordless))
    return left


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's shingle set and the component of its near duplicates."""
    return components(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP10_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT rid, array_to_string(w[i:i + {WIDTH - 1}], ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT rid, count(*) AS n FROM s GROUP BY rid
), o AS (
  SELECT a.rid AS x, b.rid AS y, count(*) AS shared FROM s a JOIN s b USING (g) WHERE a.rid <> b.rid GROUP BY 1, 2
), l AS (
  SELECT x, y FROM o JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y WHERE 100 * shared >= {PERCENT} * (nx.n + ny.n - shared)
), r(x, y) AS (
  SELECT rid, rid FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y
), low AS (
  SELECT r.x AS rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.y GROUP BY 1
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN n USING (rid) JOIN low USING (rid)
"""
