"""Benchmark decontamination (operator 3).

The benchmark's word windows become a set of hashes that is broadcast; each task slides
windows over the words of its documents, looks their hashes up in one vector operation, and
verifies every hit on the words themselves. The set is broadcast in blocks of at most
``max_windows`` windows, so its size never grows with the benchmark: a larger benchmark
means more passes over the documents, each written to the shared folder, not a larger set.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.llm.common import ship, slices, table, whole
from mentionlake.session import materialize

WIDTH = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before lower-casing, for places in a text.
WORD_PLACE = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
#: A byte that no word holds becomes a space; capital letters become small.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
BLOCK_BYTES = 4_000_000
FOUND = "n_words long, n_hit long, spans array<struct<start:int,end:int>>, items array<string>"


def word_list(text: Column) -> Column:
    """The words of a text by the rule above; null gives none."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(item string, window array<string>): ``width`` consecutive words; a shorter item is one window.

    Items without words have none; a null id is named "null"; repeated windows of an item count once.
    """
    words = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), word_list(F.col(text)).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return words.filter(F.size("w") > 0).select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("window")).distinct()


class Windows:
    """One block of benchmark windows, laid out for vector lookups."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.vocabulary: dict[bytes, int] = {}
        self.items: dict[bytes, list[str]] = {}
        by_width: dict[int, set[bytes]] = {}
        for item, window in rows:
            ids = np.array([self.vocabulary.setdefault(w.encode(), len(self.vocabulary)) for w in window.split(" ")], np.int32)
            self.items.setdefault(ids.tobytes(), []).append(item)
            by_width.setdefault(len(ids), set()).add(ids.tobytes())
        self.hashes = {
            n: np.unique(self.hash(np.stack([np.frombuffer(k, np.int32) for k in sorted(keys)]).T)) for n, keys in sorted(by_width.items())
        }

    @staticmethod
    def hash(columns) -> np.ndarray:
        total = np.uint64(0)
        for column in columns:
            total = total * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64) + np.uint64(1)
        return total

    def hits(self, ids: np.ndarray) -> list[tuple[int, int, list[str]]]:
        """(first word, width, items) of each window that occurs in a row of word numbers; -1 is no benchmark word."""
        out = []
        known = np.concatenate(([0], np.cumsum(ids >= 0)))
        for width, hashes in self.hashes.items():
            if len(ids) < width:
                continue
            at = np.flatnonzero(known[width:] - known[:-width] == width)
            slot = np.minimum(np.searchsorted(hashes, codes := self.hash([ids[at + i] for i in range(width)])), len(hashes) - 1)
            for i in at[hashes[slot] == codes].tolist():
                if items := self.items.get(ids[i : i + width].tobytes()):
                    out.append((i, width, items))
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Unions of overlapping or touching spans, in order."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _scanner(spark: SparkSession, rows: list[tuple[str, str]]):
    block = ship(spark).sparkContext.broadcast(rows)
    held: list[Windows] = []  # filled once in each task

    @F.arrow_udf(f"struct<{', '.join(c.replace(' ', ':', 1) for c in FOUND.split(', '))}>")
    def scan(column: pa.Array, spans_before: pa.Array, items_before: pa.Array) -> pa.Array:
        if not held:
            held.append(Windows(block.value))
        windows, vocabulary = held[0], held[0].vocabulary.get
        raw = [(t or "").encode() for t in column.to_pylist()]
        spans = [[(s["start"], s["end"]) for s in x or []] for x in spans_before.to_pylist()]
        items = [set(x or []) for x in items_before.to_pylist()]
        n_words = []
        for first, last in slices([len(t) for t in raw], BLOCK_BYTES):
            numbers, starts = [], [0]
            for text in raw[first:last]:
                words = text.translate(WORD_BYTES).split()
                numbers += [vocabulary(w, -1) for w in words]
                numbers.append(-1)  # no window crosses documents
                starts.append(len(numbers))
                n_words.append(len(words))
            for at, width, found in windows.hits(np.array(numbers, np.int32)):
                doc = int(np.searchsorted(starts, at, side="right")) - 1
                spans[first + doc].append((at - starts[doc], at - starts[doc] + width))
                items[first + doc].update(found)
        whole_spans = [merged(s) for s in spans]
        return pa.StructArray.from_arrays(
            [
                pa.array(n_words, pa.int64()),
                pa.array([sum(b - a for a, b in s) for s in whole_spans], pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in s] for s in whole_spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                pa.array([sorted(s) for s in items], pa.list_(pa.string())),
            ],
            ["n_words", "n_hit", "spans", "items"],
        )

    return scan


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", bench_text: str = "text",
    width: int = WIDTH, max_windows: int = 100_000, out: str = "found",
) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, n_hit, spans (word ranges inside any benchmark window), items.

    Rows are independent, so repeated ids or rows do no harm. A null or empty text, or an empty
    benchmark, gives no hit. Words of any length and texts of any length are read whole.
    """
    spark = docs.sparkSession
    windows = benchmark_windows(benchmark, item, bench_text, width).select("item", F.array_join("window", " ").alias("window"))
    blocks = max(1, -(-windows.count() // max_windows))
    nothing = F.lit(None).cast(f"struct<{', '.join(c.replace(' ', ':', 1) for c in FOUND.split(', '))}>")
    docs = docs.withColumn(out, nothing)
    for k in range(blocks):
        part = windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k)
        rows = [(r.item, r.window) for r in part.orderBy("window", "item").collect()]  # about max_windows of them
        scan = _scanner(spark, rows)
        docs = docs.withColumn(out, scan(whole(text), F.col(out)["spans"], F.col(out)["items"]))
        if k + 1 < blocks:
            docs = materialize(docs, "decontaminated")
    return docs


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what lies between them."""
    places = [m.span() for m in WORD_PLACE.finditer(text)]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return "".join([*out, text[at:]])


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    pairs = zip(texts.to_pylist(), spans.to_pylist(), strict=True)
    return pa.array([cut_words(t, [(s["start"], s["end"]) for s in x]) if x else t for t, x in pairs], pa.string())


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text", **how) -> DataFrame:
    """The documents without benchmark text, with their own columns.

    ``remove="documents"`` drops every document with a hit; ``"spans"`` keeps it without the hit words.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove documents or spans, not {remove}")
    found = find_contamination(docs, benchmark, text, out="__found", **how)
    if remove == "documents":
        return found.filter(F.col("__found.n_hit") == 0).drop("__found")
    cut = F.when(F.col("__found.n_hit") > 0, F.arrow_udf(_cut, "string")(F.col(text), F.col("__found.spans"))).otherwise(F.col(text))
    return found.withColumn(text, cut).select(*docs.columns)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words inside benchmark windows, and the items they come from, for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"),
    )


OP3_SQL = rf"""
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(w), {WIDTH}) AS size, array_to_string(w[i:i + {WIDTH - 1}], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}'), []) AS w FROM documents
), dw AS (
  SELECT rid, size, i, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)
), h AS (
  SELECT rid, size, i, item FROM dw JOIN bw USING (size, g)
), n AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM h) GROUP BY rid
), t AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN t USING (rid)
"""
