"""Hard-negative mining (operator 12): rotated one-bit codes with stored alignments, interval filter, integer scores.

Vectors are whole numbers. A fixed random rotation spreads a vector evenly over its coordinates; their signs are its code,
and the projection onto the code's direction is the stored alignment. What the code leaves over is turned and coded again,
``LAYERS`` times, and the length of the last remainder is stored too. For an anchor, turned as often, in eight bit planes, popcounts of
code and plane give its product with every code, hence an estimate of the score. The remainder is at right angles to the last
code, so by Cauchy-Schwarz it can add at most (its length) * (the part of the anchor at right angles to that code): the true
score lies in an interval that holds for certain. Pairs whose interval misses the wanted range, or lies below the
best so far, are done; the others are scored in whole numbers. The result is exact, its recall 1.

Anchors are taken in blocks of bounded size; every task scans its part of the coded rows against the block and
returns the best few per anchor, so nothing is dealt out by label and a label of any size is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from mentionlake.llm.common import ship, table
from mentionlake.session import materialize, shared_path
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LAYERS = 4
PLANES = 8
#: Anchors that are broadcast together, about.
BLOCK = 4096
#: Rows and anchors compared at once in a task.
ROWS, ANCHORS = 1024, 512
#: Coded rows per task.
SHARE = 50_000
#: Rounding of the estimates, as a part of the product of lengths.
SLACK = 1e-9
NONE = np.iinfo(np.int64).min
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def rotation(dims: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    return np.linalg.qr(np.random.default_rng(20_11).standard_normal((dims, dims)))[0]


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words."""
    raw = np.packbits(bits, axis=-1, bitorder="little")
    return np.ascontiguousarray(np.pad(raw, [(0, 0)] * (raw.ndim - 1) + [(0, -raw.shape[-1] % 8)])).view(np.uint64)


def codes_of(vectors: np.ndarray, turn: np.ndarray, layers: int = LAYERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, alignments, remainder): per row and layer its code and alignment, per row the length of what is left.

    What is left is turned again for every layer; else its coordinates would all have about one size.
    """
    left, root = vectors, np.sqrt(max(1, vectors.shape[1]))
    words, along = [], []
    for _ in range(layers):
        left = left @ turn
        up = left >= 0
        words.append(_packed(up))
        along.append(np.abs(left).sum(1) / root)
        left -= np.where(up, 1.0, -1.0) * (along[-1] / root)[:, None]
    return np.stack(words, 1), np.stack(along, 1), np.linalg.norm(left, axis=1)


def planes_of(vectors: np.ndarray, turn: np.ndarray, layers: int = LAYERS) -> dict[str, np.ndarray]:
    """Anchors as ``PLANES``-bit numbers after every turn: bit planes, their scale, and the length of the rounding error."""
    turned, out = vectors, []
    for _ in range(layers):
        turned = turned @ turn
        low = turned.min(1, initial=0)
        step = np.maximum((turned.max(1, initial=0) - low) / (2**PLANES - 1), 1e-300)
        steps = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
        planes = np.stack([_packed((steps >> j) & 1 == 1) for j in range(PLANES)], 1)
        error = np.linalg.norm(turned - (low[:, None] + step[:, None] * steps), axis=1)
        out.append((planes, low, step, steps.sum(1), error))
    return dict(zip(("planes", "low", "step", "steps", "error"), (np.stack(x, 1) for x in zip(*out)), strict=True)) | {"length": np.linalg.norm(vectors, axis=1)}


def _dense(lists: pa.Array, dims: int) -> np.ndarray:
    """Lists of numbers as rows of a matrix, zeros after a shorter one."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dims))
    out[np.arange(dims) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _encode(dims: int, kind: str, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dims)
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                whole_numbers = np.floor(scale * _dense(batch.column("vector"), dims))
                words, along, rest = codes_of(whole_numbers, turn)
                blobs = [np.ascontiguousarray(x).view(np.uint8).reshape(len(batch), -1) for x in (whole_numbers.astype(kind), words, along)]
                binary = [pa.array([r.tobytes() for r in b], pa.binary()) for b in blobs]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("anchor"), *binary, pa.array(rest)], ["id", "label", "anchor", "vector", "code", "along", "rest"])

    return run


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def intervals(words: np.ndarray, along: np.ndarray, rest: np.ndarray, a: dict[str, np.ndarray], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) possible score of every row with every anchor."""
    root = np.sqrt(max(1, dims))
    guess = np.zeros((len(words), len(a["length"])))
    reach = np.zeros(guess.shape)
    for layer in range(words.shape[1]):
        code = words[:, layer]
        ones = np.bitwise_count(code).sum(1, dtype=np.int64)
        total = np.zeros(guess.shape, np.int64)
        for j in range(PLANES):
            hits = np.zeros(guess.shape, np.int64)
            for w in range(code.shape[1]):
                hits += np.bitwise_count(code[:, None, w] & a["planes"][None, :, layer, j, w])
            total += hits << j
        beta = (a["low"][:, layer] * (2 * ones[:, None] - dims) + a["step"][:, layer] * (2 * total - a["steps"][:, layer])) / root
        guess += along[:, layer, None] * beta
        reach += along[:, layer, None] * a["error"][:, layer]
    aside = np.sqrt(np.maximum(a["length"] ** 2 - np.maximum(np.abs(beta) - a["error"][:, -1], 0) ** 2, 0))
    reach += aside * rest[:, None] + SLACK * a["length"] * (along.sum(1) + rest)[:, None]
    return guess - reach, guess + reach


class Best:
    """The best ``few`` (score, id) of every group, higher scores first, ties by smaller id."""

    def __init__(self, groups: int, few: int):
        self.few = few
        self.score = np.full((groups, few), NONE)
        self.id = np.zeros((groups, few), np.int64)
        self.n = np.zeros(groups, np.int64)

    def floor(self, low: np.ndarray) -> np.ndarray:
        """The least score that can still enter each group."""
        return np.where(self.n == self.few, np.maximum(low, self.score[:, -1]), low)

    def add(self, group: np.ndarray, score: np.ndarray, name: np.ndarray) -> None:
        full = self.n[group] == self.few
        last, last_id = self.score[group, -1], self.id[group, -1]
        useful = ~full | (score > last) | ((score == last) & (name < last_id))
        group, score, name = group[useful], score[useful], name[useful]
        if not len(group):
            return
        touched = np.unique(group)
        old = np.arange(self.few) < self.n[touched][:, None]
        group = np.concatenate((np.repeat(touched, self.n[touched]), group))
        score = np.concatenate((self.score[touched][old], score))
        name = np.concatenate((self.id[touched][old], name))
        order = np.lexsort((name, -score, group))
        group, score, name = group[order], score[order], name[order]
        first = np.searchsorted(group, group, side="left")
        rank = np.arange(len(group)) - first
        kept = rank < self.few
        self.score[group[kept], rank[kept]] = score[kept]
        self.id[group[kept], rank[kept]] = name[kept]
        self.n[touched] = np.minimum(np.bincount(np.searchsorted(touched, group), minlength=len(touched)), self.few)


def _scan(shared, dims: int, layers: int, kind: str, few: int, same: bool):
    """Rows (slot, place, id, score): the best partners of each anchor in a task's rows, per score window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        low, high = a["window"]  # per anchor and place
        places = low.shape[1]
        best = Best(low.size, few)
        # Sums of products stay exact in 64 bits up to here; beyond, Python's own numbers are used.
        exact = np.int64 if dims * float(max(1, np.abs(a["vector"]).max(initial=0))) * (2.0 ** (8 * np.dtype(kind).itemsize - 1)) < 2**62 else object
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                ids, labels = (batch.column(c).to_numpy() for c in ("id", "label"))
                vectors = _matrix(batch.column("vector"), kind, dims)
                words = _matrix(batch.column("code"), "<u8", layers * (-(-dims // 64))).reshape(len(batch), layers, -(-dims // 64))
                along, rest = _matrix(batch.column("along"), "<f8", layers), batch.column("rest").to_numpy()
                for rows, tile in _tiles(labels, a["label"], same):
                    floor = np.where(high[tile] >= low[tile], best.floor(low.ravel()).reshape(low.shape)[tile].astype(float), np.inf).min(1)
                    top = np.inf if same else high[tile].max(1).astype(float)
                    part = {k: a[k][tile] for k in ("planes", "low", "step", "steps", "error", "length")}
                    lowest, highest = intervals(words[rows], along[rows], rest[rows], part, dims)
                    open_ = (highest >= floor) & (lowest <= top)
                    if not same:
                        open_ &= labels[rows][:, None] != a["label"][tile]
                    i, j = np.nonzero(open_ & (ids[rows][:, None] != a["id"][tile]))
                    i, j = rows[i], tile[j]
                    for cut in range(0, len(i), 1 << 16):
                        p, q = i[cut : cut + (1 << 16)], j[cut : cut + (1 << 16)]
                        score = (vectors[p].astype(np.int64).astype(exact) * a["vector"][q].astype(np.int64).astype(exact)).sum(1).astype(np.int64)
                        for place in range(places):
                            inside = (score >= low[q, place]) & (score <= high[q, place])
                            best.add(q[inside] * places + place, score[inside], ids[p[inside]])
        group, rank = np.nonzero(np.arange(few) < best.n[:, None])
        columns = [group // places, group % places, best.id[group, rank], best.score[group, rank]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["slot", "place", "id", "score"])

    return run


def _tiles(labels: np.ndarray, anchors: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, anchors) to compare: of one label, or all rows with all anchors."""
    if not same:
        yield from ((np.arange(len(labels)), np.arange(k, min(k + ANCHORS, len(anchors)))) for k in range(0, len(anchors), ANCHORS))
        return
    for label in np.intersect1d(labels, anchors):
        of = np.flatnonzero(anchors == label)
        yield from ((np.flatnonzero(labels == label), of[k : k + ANCHORS]) for k in range(0, len(of), ANCHORS))


def _first(found: DataFrame, few: int) -> DataFrame:
    order = Window.partitionBy("slot", "place").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= few)


def mine(vectors: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), see ``RESULT``.

    The rows where ``anchors`` holds are compared with all rows. A component x counts as floor(scale * x); a score is the
    product of two rows. An anchor's positives are the first rows of its label, its negatives for one of them the first
    rows of other labels that score between ``low`` and ``high`` per cent of it; higher scores first, ties by smaller key.
    Rows with a null key, label, vector or component, or one that is not finite, take no part; shorter vectors end in zeros. A
    row never meets rows of its own key; rows repeated otherwise count as often as they occur, a repeated anchor once.
    Scores beyond 64 bits are an error, as in SQL. Other columns take no part. An empty table has no result.
    """
    spark = ship(vectors.sparkSession)
    sound = vectors[key].isNotNull() & vectors[label].isNotNull() & F.forall(vectors[vector], lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = vectors.filter(sound).select(vectors[key].cast("long").alias("id"), vectors[label].cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), vectors[vector].cast("array<double>").alias("vector"))
    reach = F.floor(F.lit(scale) * F.greatest(F.array_max("vector"), -F.array_min("vector"))) + 1
    facts = clean.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dims"), F.max(reach.cast("double")).alias("reach")).first()
    dims = max(1, facts.dims or 0)
    kind = "<i2" if (facts.reach or 0) < 2**15 else "<i4" if facts.reach < 2**31 else "<f8"
    tasks = max(spark.sparkContext.defaultParallelism, facts.n // SHARE)
    schema = "id long, label long, anchor boolean, vector binary, code binary, along binary, rest double"
    coded = materialize(clean.repartition(tasks).mapInArrow(_encode(dims, kind, scale), schema), "codes")

    chosen = coded.filter("anchor").select("id", "label", "vector").distinct()
    blocks = -(-chosen.count() // block)
    path = shared_path(spark, "negatives")
    spark.createDataFrame([], RESULT).write.parquet(path)
    for k in range(blocks):
        rows = chosen.filter(F.pmod(F.xxhash64("id", "label", "vector"), F.lit(blocks)) == k).toArrow().combine_chunks()
        if not len(rows):
            continue
        value = _matrix(rows.column("vector").combine_chunks(), kind, dims)
        a = {"id": rows.column("id").to_numpy(), "label": rows.column("label").to_numpy(), "vector": value} | planes_of(value.astype(float), rotation(dims))

        def scan(few: int, same: bool, window: tuple[np.ndarray, np.ndarray]) -> DataFrame:
            sent = spark.sparkContext.broadcast(a | {"window": window})
            columns = coded.select("id", "label", "vector", "code", "along", "rest")
            return _first(columns.mapInArrow(_scan(sent, dims, LAYERS, kind, few, same), "slot long, place long, id long, score long"), few)

        everything = (np.full((len(a["id"]), 1), NONE + 1), np.full((len(a["id"]), 1), np.iinfo(np.int64).max))
        near = scan(positives, True, everything).select("slot", F.col("rank") - 1, "id", "score").toArrow()
        slot, rank, who, score = (near.column(c).to_numpy() for c in range(4))
        window = (np.zeros((len(a["id"]), positives), np.int64), np.full((len(a["id"]), positives), -1))
        # Whole scores between low and high per cent of the positive's; nothing lies between them if it is negative.
        for at, place, s in zip(slot.tolist(), rank.tolist(), score.tolist(), strict=True):
            window[0][at, place], window[1][at, place] = -(-low * s // 100), high * s // 100
        pairs = spark.createDataFrame(pa.table({"slot": slot, "place": rank.astype(np.int64), "anchor_id": a["id"][slot], "positive_id": who, "positive_score": score}))
        found = scan(negatives, False, window).join(F.broadcast(pairs), ["slot", "place"])  # at most ``positives`` rows an anchor of the block
        found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector against all vectors; every seventh label is moved on by one first."""
    rows = table(spark, sf_dir, "embeddings")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(moved, F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS alike, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0) a JOIN v r ON a.vec_id <> r.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 5
"""
