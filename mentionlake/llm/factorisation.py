"""Quality classifier (operator 4): a factorisation machine.

A document becomes a sparse vector: its distinct words, hashed; its structure statistics and
its metadata, each as a one-of-n bin. The score adds a weight per feature and, for every pair
of features, the product of their low-rank vectors. By the identity
    sum over pairs <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)
that takes time linear in the number of features. The model is fitted with AdaGrad on a
bounded sample of labelled rows (``max_rows``) and broadcast: its size is fixed by ``SLOTS``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.llm.common import ship, slices, table, whole

WORD_SLOTS = 1 << 15
BINS = 16
RANK = 8
BLOCK_BYTES = 4_000_000
SYMBOLS, CAPITALS, DIGITS = b"#*$%&|<>{}[]=_~^", bytes(range(0x41, 0x5B)), bytes(range(0x30, 0x3A))
MARKS = b"!?.,;:"
N_STATISTICS = 14
SLOTS = WORD_SLOTS + (N_STATISTICS + 4) * BINS


def _level(value: float, top: float = 1.0) -> int:
    """Bin of a share: finer near zero."""
    return min(BINS - 1, int(BINS * (max(value, 0.0) / top) ** 0.5))


def statistics(raw: bytes, words: list[bytes], counts: Counter) -> list[int]:
    """Bins of the structure statistics of one text."""
    n, size = max(1, len(words)), max(1, len(raw))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    without = lambda chars: (size - len(raw.translate(None, chars))) / size if raw else 0.0
    most = max(counts.values(), default=0)
    pairs = len(set(zip(words, words[1:], strict=False)))
    singles = [raw.count(c) / n for c in (b"!", b"|", b"$")]
    return [
        min(BINS - 1, int(np.log2(n + 1))),
        _level(without(SYMBOLS), 0.5),
        _level(without(CAPITALS)),
        _level(without(DIGITS), 0.5),
        _level(without(MARKS), 0.5),
        _level(len(counts) / n),
        _level(most / n),
        _level(pairs / max(1, n - 1)),
        _level(1 - len(set(lines)) / max(1, len(lines))),
        min(BINS - 1, int((size - raw.count(b" ")) / n)),
        min(BINS - 1, int(np.log2(n / max(1, len(lines)) + 1))),
        *(_level(x) for x in singles),
    ]


class Featuriser:
    """Sparse vectors of texts; remembers the slots of words within a task."""

    def __init__(self):
        self.slot: dict[bytes, int] = {}

    def vector(self, raw: bytes, meta: list[float | None]) -> tuple[np.ndarray, np.ndarray]:
        words = raw.split()
        counts = Counter(words)
        slot, slots = self.slot, []
        if len(slot) > 300_000:
            slot.clear()
        for word in counts:
            if (k := slot.get(word)) is None:
                k = slot[word] = zlib.crc32(word.lower()) % WORD_SLOTS
            slots.append(k)
        bins = statistics(raw, words, counts)
        bins += [0 if m is None else min(BINS - 1, 1 + int(np.log2(max(float(m), 0.0) + 1))) for m in meta]
        stats = [WORD_SLOTS + i * BINS + b for i, b in enumerate(bins)]
        values = np.full(len(slots) + len(stats), 0.5, np.float32)
        values[: len(slots)] = 1 / np.sqrt(max(1, len(slots)))
        return np.array(slots + stats, np.int32), values


@dataclass
class Machine:
    """Bias, weights and low-rank vectors."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def margins(self, slots: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The score before the logistic function, of rows laid end to end; every row has a feature."""
        v = self.vectors[slots] * values[:, None]
        linear = np.add.reduceat(self.weights[slots] * values, starts)
        total, squares = np.add.reduceat(v, starts), np.add.reduceat(v * v, starts)
        return self.bias + linear + 0.5 * (total * total - squares).sum(1)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, least_steps: int = 400, step: float = 0.05, decay: float = 1e-5, seed: int = 7) -> Machine:
    """AdaGrad on the log loss, in batches of 128 rows; the same rows give the same model.

    Few rows are gone over more often, until ``least_steps`` batches were seen.
    """
    random = np.random.default_rng(seed)
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
    model = Machine(float(np.log(share / (1 - share))), np.zeros(SLOTS, np.float32), random.normal(0, 0.02, (SLOTS, RANK)).astype(np.float32))
    seen_w, seen_v = np.full(SLOTS, 1e-4, np.float32), np.full((SLOTS, RANK), 1e-4, np.float32)
    batches = max(1, len(rows) // 128)
    for _ in range(max(epochs, -(-least_steps // batches)) if len(rows) else 0):
        for batch in np.array_split(random.permutation(len(rows)), batches):
            slots = np.concatenate([rows[i][0] for i in batch])
            values = np.concatenate([rows[i][1] for i in batch])
            sizes = np.array([len(rows[i][0]) for i in batch])
            starts = np.cumsum(sizes) - sizes
            error = (logistic(model.margins(slots, values, starts)) - labels[batch]).astype(np.float32) / len(batch)
            row = np.repeat(np.arange(len(batch)), sizes)
            v = model.vectors[slots] * values[:, None]
            total = np.add.reduceat(v, starts)
            grad = np.empty((len(slots), RANK + 1), np.float32)
            grad[:, 0] = error[row] * values
            grad[:, 1:] = grad[:, :1] * (total[row] - v)
            order_slots = np.argsort(slots, kind="stable")
            distinct, first = np.unique(slots[order_slots], return_index=True)
            summed = np.add.reduceat(grad[order_slots], first)
            summed[:, 0] += decay * model.weights[distinct]
            summed[:, 1:] += decay * model.vectors[distinct]
            seen_w[distinct] += summed[:, 0] ** 2
            seen_v[distinct] += summed[:, 1:] ** 2
            model.weights[distinct] -= step * summed[:, 0] / np.sqrt(seen_w[distinct])
            model.vectors[distinct] -= step * summed[:, 1:] / np.sqrt(seen_v[distinct])
            model.bias -= step * float(error.sum())
    return model


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text is divisible by five."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _meta(docs: DataFrame, metadata: tuple[str, ...]) -> Column:
    """The metadata numbers of a row; a missing, infinite or undefined one is null."""
    finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)
    have = [finite(F.col(c).cast("double")) for c in metadata if c in docs.columns]
    return F.array(*have) if have else F.array().cast("array<double>")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = ("n_chars",), max_rows: int = 12_000) -> Machine:
    """A machine fitted on at most ``max_rows`` labelled rows, those of smallest hash; held-out rows are never read.

    Only sparse vectors of these rows reach the driver, ``max_rows`` of them also where ids repeat: then the
    first in order of id and vector count. Of conflicting labels of an id the largest counts. Rows without a
    label, id or document are left out; without any the model is the constant one half.
    """
    ship(docs.sparkSession)
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    sample = known.groupBy(F.col(key).alias("__key")).agg(F.max(label).cast("int").alias("__label")).orderBy(F.xxhash64("__key"), "__key").limit(max_rows)

    @F.arrow_udf("struct<slots:binary,shares:binary>")
    def vectors(texts: pa.Array, meta: pa.Array) -> pa.Array:
        make = Featuriser()
        pairs = [make.vector(t.encode(), m) for t, m in zip(texts.to_pylist(), meta.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([s.tobytes() for s, _ in pairs], pa.binary()), pa.array([v.tobytes() for _, v in pairs], pa.binary())], ["slots", "shares"])

    # The broadcast side has at most ``max_rows`` rows of two numbers.
    chosen = docs.join(F.broadcast(sample), docs[key] == F.col("__key")).select("__key", "__label", vectors(whole(text), _meta(docs, metadata)).alias("x"))
    rows = chosen.select("__key", "__label", "x.slots", "x.shares").orderBy("__key", "slots", "shares").limit(max_rows).collect()
    return fit([(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in rows], np.array([r[1] for r in rows], np.float32))


def score_documents(docs: DataFrame, model: Machine, text: str = "text", metadata: tuple[str, ...] = ("n_chars",), out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in column ``out`` (replaced if it exists).

    Empty and null texts are scored by their statistics; missing, infinite or undefined metadata has a bin of its own.
    """
    held = ship(docs.sparkSession).sparkContext.broadcast((model.bias, model.weights, model.vectors))
    machine: list[Machine] = []
    make = Featuriser()

    @F.arrow_udf("double")
    def score(texts: pa.Array, meta: pa.Array) -> pa.Array:
        if not machine:
            machine.append(Machine(*held.value))
        raw, other, out = [t.encode() for t in texts.to_pylist()], meta.to_pylist(), [np.zeros(0)]
        for start, end in slices([len(t) for t in raw], BLOCK_BYTES):
            rows = [make.vector(t, m) for t, m in zip(raw[start:end], other[start:end], strict=True)]
            sizes = np.array([len(s) for s, _ in rows])
            out.append(machine[0].margins(np.concatenate([s for s, _ in rows]), np.concatenate([v for _, v in rows]), np.cumsum(sizes) - sizes))
        return pa.array(logistic(np.concatenate(out).astype(np.float64)), pa.float64())

    return docs.withColumn(out, score(whole(text), _meta(docs, metadata)))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
