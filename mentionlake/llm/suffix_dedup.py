"""Suffix-array dedup (operator 8): bytes inside long strings that occur more than once go.

A string of ``length`` bytes is a window. Every window has an anchor, a place of its smallest hashed q-gram:
the one of the window before as long as it will do, else the rightmost. Equal windows have equal smallest q-grams, so
windows can be dealt out by that hash, about one row for every ``length / 2`` bytes, and never meet in more
than one bucket. A row covers the consecutive windows of one anchor; the bytes they span are its snippet.

* Buckets with one row repeat only inside it, where its q-gram occurs again; the others end there.
* Equal snippets repeat as a whole; that is a count per snippet, combined on the map side, and
  only one of each goes on. This is where large groups of copies collapse.
* Different snippets of one bucket, cut once from the documents that hold them, are sorted by bucket-pointer
  refinement: buckets of equal 8-byte grams are refined by sorting on the bucket numbers found further on, first
  8 bytes on, then 16, and so on with the refined numbers, until buckets hold equal windows.
* Buckets of more than ``max_bucket`` different snippets, which could outgrow a task, compare
  windows by 128-bit hashes in a grouped count instead. The result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.llm.common import discard, ship, slices, table, whole
from mentionlake.operators.joins import skewed_lookup
from mentionlake.session import materialize

LENGTH = 400
GRAM = 32
#: Bytes of a text looked at together; longer texts are cut with full overlap.
SEGMENT = 1 << 16
#: Bytes of snippets refined together; a block ends between buckets.
BLOCK = 2_000_000
MAX_BUCKET = 20_000
#: Text handled and rows returned at once.
SLICE, ROWS = 4_000_000, 50_000
M1, M2, P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
PLACE = np.uint64(SEGMENT * 2 - 1)


def words_at(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes that start at each place, as one number."""
    return np.ndarray(max(0, len(raw) - 7), "<u8", raw, strides=(1,)).copy()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive numbers, in three passes."""
    n = len(x)
    pad = np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)
    rows = np.concatenate((x, pad)).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(raw: bytes, length: int, gram: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """(bucket hash, first window start, last window start, anchor place, whether its q-gram recurs) of each anchor of a text."""
    for at in range(0, max(0, len(raw) - length + 1), SEGMENT):
        part = np.frombuffer(raw, np.uint8)[at : at + SEGMENT + length - 1]
        eight = words_at(part)
        grams = np.zeros(len(part) - gram + 1, np.uint64)
        for k in range(0, gram, 8):
            grams = mix(grams * P + eight[k : k + len(grams)])
        # The bits that rank places count them backwards, so that of equal hashes the rightmost is the least.
        ranked = (grams & ~PLACE) | (PLACE - np.arange(len(grams), dtype=np.uint64))
        least = sliding_least(ranked, length - gram + 1)
        place = (PLACE - (least & PLACE)).astype(np.int64)
        least = (least & ~PLACE).view(np.int64)
        cut = np.flatnonzero(np.diff(least)) + 1
        first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(place)])) - 1
        for s, e, spot, end, bucket in zip(first.tolist(), last.tolist(), place[first].tolist(), place[last].tolist(), least[first].tolist(), strict=True):
            if spot == end:
                yield bucket, s + at, e + at, spot + at, False
                continue
            while s <= e:  # equal hashes in sight: an anchor serves until windows leave it behind
                spot = int(place[s])
                to = min(spot, e)
                yield bucket, s + at, to + at, spot + at, int(place[to]) != spot
                s = to + 1


def _snippet(raw: bytes, first: int, last: int, spot: int, length: int) -> int:
    return xxhash.xxh3_64_intdigest(raw[first : last + length], spot - first) - (1 << 63)


def _texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, bytes]]:
    """(row, UTF-8 bytes) of a batch, unpacked a part at a time."""
    texts = batch.column(column)
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
    for a, b in slices(sizes, SLICE):
        yield from enumerate(texts.slice(a, b - a).cast(pa.binary()).to_pylist(), a)


def _anchor_rows(length: int, gram: int):
    names = ["bucket", "snippet", "first", "last", "again"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())

    def packed(batch: pa.RecordBatch, owner: list[int], out: list[tuple]) -> pa.RecordBatch:
        taken = batch.select(["key", "text_hash"]).take(pa.array(owner, pa.int64()))
        columns = zip(*out, strict=True) if out else ([],) * len(kinds)
        return pa.RecordBatch.from_arrays([*taken.columns, *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["key", "text_hash", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, out = [], []
            for i, raw in _texts(batch):
                for bucket, first, last, spot, again in anchors(raw, length, gram):
                    owner.append(i)
                    out.append((bucket, _snippet(raw, first, last, spot, length), first, last, again))
                    if len(out) >= ROWS:
                        yield packed(batch, owner, out)
                        owner, out = [], []
            yield packed(batch, owner, out)

    return run


def _snippet_bytes(length: int):
    """Rows (bucket, snippet, body) from texts with the ranges wanted of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            wanted = batch.column("wanted")
            for i, raw in _texts(batch):
                for w in wanted[i].as_py():
                    out.append((w["bucket"], w["snippet"], raw[w["first"] : w["last"] + length]))
                    size += len(out[-1][2])
                if size > SLICE:
                    yield _bodies(out)
                    out, size = [], 0
            yield _bodies(out)

    return run


def _bodies(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["bucket", "snippet", "body"])


def repeated_windows(body: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Places in ``body``, snippets laid end to end, where a window starts that also starts elsewhere.

    ``number[i]`` is the bucket of the first q bytes from i, or -1 where no other place agrees on them.
    """
    ends = np.cumsum(sizes)
    room = np.repeat(ends, sizes) - np.arange(len(body))
    number = np.full(len(body) + length, -1, np.int64)

    def rename(places: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Buckets of equal keys get new numbers; places alone in theirs are dropped."""
        order = np.argsort(keys, kind="stable")
        new = np.empty(len(keys), bool)
        new[:1], new[1:] = True, np.diff(keys[order]) != 0
        many = ~(new & np.append(new[1:], True))
        places, numbers = places[order][many], np.cumsum(new)[many]
        number.fill(-1)
        number[places] = numbers
        return places

    places = np.flatnonzero(room >= 8)
    places = rename(places, words_at(body)[places])
    q = 8
    while q < length:
        ahead = min(q, length - q)
        places = places[room[places] >= q + ahead]
        pointer = number[places + ahead]
        places, pointer = places[pointer >= 0], pointer[pointer >= 0]
        places = rename(places, number[places] * (len(body) + 1) + pointer)
        q += ahead
    return np.sort(places)


def _refine(length: int):
    """Rows (bucket, snippet, low, high) of repeated windows, from snippets sorted by bucket."""

    def solve(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        sizes = np.array([len(b) for _, _, b in held])
        places = repeated_windows(np.frombuffer(b"".join(b for _, _, b in held), np.uint8), sizes, length)
        starts = np.cumsum(sizes) - sizes
        owner = np.searchsorted(starts, places, side="right") - 1
        new = np.flatnonzero((np.diff(places, prepend=-2) != 1) | (np.diff(owner, prepend=-1) != 0))
        low, high = places[new], places[np.append(new[1:], len(places)) - 1] if len(new) else places[:0]
        who = owner[new].tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array([held[i][0] for i in who], pa.int64()), pa.array([held[i][1] for i in who], pa.int64()), pa.array(low - starts[who] if who else [], pa.int32()), pa.array(high - starts[who] if who else [], pa.int32())],
            ["bucket", "snippet", "low", "high"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "snippet", "body")), strict=True):
                if size > BLOCK and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield solve(held)

    return run


def _window_hashes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, snippet, body in zip(*(batch.column(c).to_pylist() for c in ("bucket", "snippet", "body")), strict=True):
                n = len(body) - length + 1
                names = [xxhash.xxh3_128_digest(body[i : i + length]) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * n, pa.int64()), pa.array([snippet] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(names, pa.binary())], ["bucket", "snippet", "low", "name"])

    return run


def _compare(bodies: DataFrame, length: int, max_bucket: int) -> DataFrame:
    """(bucket, snippet, low, high) of windows that occur elsewhere in the bodies of their bucket."""
    counts = bodies.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    marked = skewed_lookup(bodies, counts, "bucket")
    usual = marked.filter(F.col("n") <= max_bucket).select("bucket", "snippet", "body")
    refined = usual.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_refine(length), "bucket long, snippet long, low int, high int")
    large = marked.filter(F.col("n") > max_bucket).select("bucket", "snippet", "body").mapInArrow(_window_hashes(length), "bucket long, snippet long, low int, name binary")
    twice = large.groupBy("bucket", "name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    counted = skewed_lookup(large.select(F.struct("bucket", "name").alias("at"), "snippet", "low"), twice.select(F.struct("bucket", "name").alias("at"), "n"), "at")
    return refined.unionByName(counted.select("at.bucket", "snippet", "low", F.col("low").alias("high")))


def repeated_spans(docs: DataFrame, key: str, text: str, length: int = LENGTH, gram: int = GRAM, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(key, text_hash, spans): the byte ranges of each document that lie in repeated windows, unmerged."""
    if gram % 8 or not 8 <= gram <= length:
        raise ValueError("a q-gram has a multiple of 8 bytes and fits the length")
    ship(docs.sparkSession)
    named = docs.select(F.col(key).alias("key"), F.xxhash64(whole(text)).alias("text_hash"), whole(text).alias("text")).filter(F.octet_length("text") >= length)
    kind = named.schema["key"].dataType.simpleString()
    schema = f"key {kind}, text_hash long, bucket long, snippet long, first int, last int, again boolean"
    rows = materialize(named.mapInArrow(_anchor_rows(length, gram), schema), "anchors")

    # One row per snippet, with a place where it can be read, and what its bucket holds.
    place = F.min(F.struct("key", "text_hash", "first", "last")).alias("place")
    names = rows.groupBy("bucket", "snippet").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again"), place)
    buckets = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), (F.min("snippet") != F.max("snippet")).alias("several"), F.max("again").alias("any_again"))
    buckets = materialize(buckets.filter("m > 1 or any_again"), "shared-buckets")
    names = skewed_lookup(names, buckets, "bucket", "m").select("bucket", "snippet", "n", "place", (F.col("several") | F.col("any_again")).alias("mixed"))
    names = materialize(names, "shared-snippets")

    # Copied snippets repeat as a whole, wherever they are.
    copied = names.filter("n > 1").select(F.struct("bucket", "snippet").alias("name"), "n")
    equal = skewed_lookup(rows.withColumn("name", F.struct("bucket", "snippet")), copied, "name")
    equal = equal.select("key", "text_hash", F.col("first").alias("start"), (F.col("last") + length).alias("end"))

    # The others are compared with what their bucket holds; each snippet is cut from one of its documents.
    wanted = names.filter("mixed").select("place.*", F.struct("bucket", "snippet", "place.first", "place.last").alias("w"))
    wanted = wanted.groupBy(F.col("key").alias("__key"), F.col("text_hash").alias("__hash")).agg(F.collect_list("w").alias("wanted"))
    held = named.join(wanted, named["key"].eqNullSafe(F.col("__key")) & (F.col("text_hash") == F.col("__hash"))).select("text", "wanted")
    bodies = held.mapInArrow(_snippet_bytes(length), "bucket long, snippet long, body binary").dropDuplicates(["bucket", "snippet"])
    bodies = materialize(bodies, "snippets")
    found = materialize(_compare(bodies, length, max_bucket), "repeated-windows")
    single = names.filter("mixed and n = 1").select("bucket", "snippet", "place")
    partly = single.join(found, ["bucket", "snippet"]).select("place.key", "place.text_hash", (F.col("place.first") + F.col("low")).alias("start"), (F.col("place.first") + F.col("high") + length).alias("end"))
    spans = materialize(equal.unionByName(partly).groupBy("key", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "repeated-spans")
    for done in (rows, buckets, names, bodies, found):
        discard(done)
    return spans


def cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(bytes left, bytes removed, number of maximal removed runs)."""
    out, at, removed, runs = [], 0, 0, 0
    for start, end in sorted(spans):
        if start > at or not runs:
            out.append(raw[at:start])
            runs += 1
            at = start
        if end > at:
            removed += end - at
            at = end
    return b"".join([*out, raw[at:]]), removed, runs


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "cut", **how) -> DataFrame:
    """``docs`` with a struct column ``out``: kept (the bytes left), n_removed, n_spans.

    Occurrences are judged on the input: both of two equal strings go, in one document or in two.
    Null reads as empty. Keys may repeat or be null: a row is known by its key and text, so exact
    repeats of a row repeat each other. Texts shorter than ``length`` bytes stay as they are.
    """
    spans = repeated_spans(docs, key, text, **how).withColumnsRenamed({"key": "__key", "text_hash": "__hash", "spans": "__spans"})

    @F.arrow_udf("struct<kept:binary,n_removed:long,n_spans:long>")
    def apply(texts: pa.Array, found: pa.Array) -> pa.Array:
        rows = []
        for t, s in zip(texts, found, strict=True):
            raw = t.as_py().encode()
            rows.append(cut(raw, [(x["start"], x["end"]) for x in s.as_py()]) if s.is_valid else (raw, 0, 0))
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64()))], ["kept", "n_removed", "n_spans"])

    joined = docs.join(spans, docs[key].eqNullSafe(F.col("__key")) & (F.xxhash64(whole(text)) == F.col("__hash")), "left")
    return joined.withColumn(out, apply(whole(text), F.col("__spans"))).drop("__key", "__hash", "__spans")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document loses to repeated 400-byte strings, and the digest of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", F.octet_length(whole("text")).cast("long").alias("n_bytes"), "cut.n_removed", "cut.n_spans", F.sha2("cut.kept", 256).alias("kept_sha256")
    )


OP8_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents
), w AS (
  SELECT rid, i, md5(substr(x, 2 * i + 1, {2 * LENGTH})) AS g
  FROM (SELECT rid, x, unnest(range(0, len(x) // 2 - {LENGTH - 1})) AS i FROM d WHERE len(x) >= {2 * LENGTH})
), r AS (
  SELECT rid, i, i - lag(i) OVER (PARTITION BY rid ORDER BY i) AS gap FROM w SEMI JOIN (SELECT g FROM w GROUP BY g HAVING count(*) > 1) USING (g)
), runs AS (
  SELECT rid, n, min(i) AS s, max(i) + {LENGTH} AS e
  FROM (SELECT rid, i, sum(CASE WHEN gap <= {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS n FROM r) GROUP BY rid, n
), kept AS (
  SELECT rid, sum(e - s) AS n_removed, count(*) AS n_spans, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es FROM runs GROUP BY rid
)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  CASE WHEN ss IS NULL THEN sha256(unhex(x)) ELSE sha256(unhex(array_to_string(list_transform(range(0, len(ss) + 1),
    lambda k: substr(x, 2 * CASE WHEN k = 0 THEN 0 ELSE es[k] END + 1, 2 * (CASE WHEN k = len(ss) THEN len(x) // 2 ELSE ss[k + 1] END - CASE WHEN k = 0 THEN 0 ELSE es[k] END))), ''))) END AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
