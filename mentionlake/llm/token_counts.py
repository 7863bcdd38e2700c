"""Token counts (operator 5): a two-tier lookup on the map side.

A first pass over all documents lets every task keep the most frequent pre-tokens it saw, as one
row. These summaries of bounded size are merged in a tree, group by group of tasks, each merge
again bounded, so no exchange is keyed by a pre-token and no task sees more than some summaries. The
last one becomes a compact hash table of packed arrays (sorted hashes, places, bytes, lengths)
that is broadcast. The counting pass looks the distinct pre-tokens of a block up there; those it
misses are encoded by the worker's own coder, whose memory serves later blocks. The table never
changes a result, it only saves encoding.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.llm.bpe import Coder, default_path, tokenizer_text, worker_coder
from mentionlake.llm.common import ship, slices, table, whole

#: Characters of text whose pre-tokens are held at once.
BLOCK_CHARS = 4_000_000
#: Longer pre-tokens are left to the workers' coders.
TIER_CHARS = 512
#: Groups of summaries in each round of merging.
TREE = (4_096, 64, 1)


SUMMARY = "part long, words array<string>, counts array<long>"


def _summary(part: int, seen: Counter, keep: int) -> pa.RecordBatch:
    """One row: the ``keep`` most frequent pre-tokens, ties by the text."""
    top = heapq.nsmallest(keep, seen.items(), key=lambda x: (-x[1], x[0]))
    words, counts = pa.array([[w for w, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), words, counts], ["part", "words", "counts"])


def _summarise(spec, per_task: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen = worker_coder(spec), Counter()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for start, end in slices([len(t) for t in texts], BLOCK_CHARS):
                for text in texts[start:end]:
                    seen.update(w for w in coder.pretokens(text) if isinstance(w, str))
                if len(seen) > 50 * per_task:  # rare ones go; this tier needs the frequent ones only
                    seen = Counter(dict(seen.most_common(10 * per_task)))
        yield _summary(TaskContext.get().partitionId(), seen, per_task)

    return run


def _merge(keep: int):
    def run(group: pa.Table) -> pa.Table:
        seen: Counter = Counter()
        for words, counts in zip(group.column("words"), group.column("counts"), strict=True):
            for word, n in zip(words.as_py(), counts.as_py(), strict=True):
                seen[word] += n
        return pa.Table.from_batches([_summary(group.column("part")[0].as_py(), seen, keep)])

    return run


def frequent_pretokens(docs: DataFrame, path: str, text: str | Column = "text", top: int = 32_768, per_task: int = 4_096) -> DataFrame:
    """(pretoken, n): the ``top`` pre-tokens that tasks met most often, by the tasks' own summaries.

    Ties are broken by the text. An empty table gives no rows.
    """
    spec = ship(docs.sparkSession).sparkContext.broadcast(tokenizer_text(path))
    parts = docs.select(whole(text).alias("text")).mapInArrow(_summarise(spec, per_task), SUMMARY)
    for groups in TREE:
        parts = parts.withColumn("part", F.pmod("part", F.lit(groups))).groupBy("part").applyInArrow(_merge(top), SUMMARY)
    return parts.select(F.explode(F.arrays_zip(F.col("words").alias("pretoken"), F.col("counts").alias("n"))).alias("x")).select("x.pretoken", "x.n")


@dataclass
class Tier:
    """A hash table of texts and their numbers of tokens in four arrays."""

    hashes: np.ndarray
    starts: np.ndarray
    text: bytes
    lengths: np.ndarray

    @classmethod
    def of(cls, words: list[str], lengths: list[int]) -> Tier:
        raw = [w.encode() for w in words]
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))
        order = np.argsort(hashes, kind="stable")
        starts = np.concatenate([[0], np.cumsum([len(raw[i]) for i in order])]).astype(np.int64)
        return cls(hashes[order], starts, b"".join(raw[i] for i in order), np.array(lengths, np.int64)[order])

    def find(self, words: list[str]) -> dict[str, int]:
        """The lengths of the words it holds; a hash alone decides nothing, the bytes must agree."""
        if not len(self.hashes) or not words:
            return {}
        raw = [w.encode() for w in words]
        wanted = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        held = np.flatnonzero(self.hashes[at] == wanted)
        at = at[held]
        found = zip(held.tolist(), self.starts[at].tolist(), self.starts[at + 1].tolist(), self.lengths[at].tolist(), strict=True)
        return {words[i]: n for i, start, end, n in found if self.text[start:end] == raw[i]}


def count_tokens(docs: DataFrame, path: str, text: str | Column = "text", out: str = "n_tokens", top: int = 32_768) -> DataFrame:
    """``docs`` with the number of tokens of the whole text in column ``out`` (long, replaced if it exists).

    A null or empty text has none; special strings inside a text are one token each; repeated
    rows and rows with nulls elsewhere are counted like any other.
    """
    spark = ship(docs.sparkSession)
    source = tokenizer_text(path)
    # At most ``top`` rows of at most TIER_CHARS characters reach the driver; their lengths come from the same coder.
    frequent = frequent_pretokens(docs, path, text, top).filter(F.length("pretoken") <= TIER_CHARS)
    words = [r.pretoken for r in frequent.collect()]
    tier = Tier.of(words, [len(ids) // 4 for ids in Coder(source).learn(words)] if words else [])
    spec = spark.sparkContext.broadcast(source)
    held = spark.sparkContext.broadcast((tier.hashes, tier.starts, tier.text, tier.lengths))

    @F.arrow_udf("long")
    def count(column: pa.Array) -> pa.Array:
        coder, known = worker_coder(spec), Tier(*held.value)
        texts, totals = column.to_pylist(), []
        for start, end in slices([len(t) for t in texts], BLOCK_CHARS):
            cut = [coder.pretokens(t) for t in texts[start:end]]
            distinct = set(chain.from_iterable(cut))
            sizes = known.find([w for w in distinct if isinstance(w, str)])
            missed = list(distinct.difference(sizes))
            sizes.update((w, len(ids) // 4) for w, ids in zip(missed, coder.learn(missed), strict=True))
            totals += [sum(map(sizes.__getitem__, words)) for words in cut]
        return pa.array(totals, pa.int64())

    return docs.withColumn(out, count(whole(text)))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it is over 2048 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, default_path("word_bpe_49k.json")).select(
        "doc_id", F.octet_length(whole("text")).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit")
    )
