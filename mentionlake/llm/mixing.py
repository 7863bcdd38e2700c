"""Mixing sources to target weights (operator 11): a time-varying curriculum, in SQL functions only.

Every source has a weight schedule over training time 0 to 1: knots joined by straight lines. The integral
of the schedule is the source's weight in the whole mix; it decides the words the mix takes from it (the
target). The integral up to a time, scaled to the target, is the source's cumulative demand. A source's
documents are laid end to end in a fixed scattered order (MD5 of the key), as often as the target needs, and the place
of a document's middle word on that line is looked up in the inverse demand: that is its training position.
Sorting by position interleaves the sources as their schedules ask at every moment.

The places come from range-partitioned running sums (``common.running``): a source of any size is spread over many
tasks. What grows with the number of sources stays in tables; the driver sees three numbers.
"""

from __future__ import annotations

from mentionlake.llm.common import running, table, whole
from mentionlake.session import materialize
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: A source's target stops at so many times its size.
MOST = 3
#: The query's weights, dealt to the sources by code point, and how each changes from start to end.
WEIGHTS = (5.0, 2.0, 1.0)
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def _segments(knots: Column) -> Column:
    """The schedule's straight pieces (t0, t1, w0, w1, c0, c1), with the integral at both ends."""
    first, last = F.element_at(knots, 1), F.element_at(knots, -1)
    ends = lambda at, knot: F.array(F.struct(F.lit(at).alias("at"), knot["weight"].alias("weight")))
    padded = F.concat(ends(0.0, first), knots, ends(1.0, last))

    def piece(a: Column, i: Column) -> Column:
        b = F.element_at(padded, i + 2)
        return F.struct(a["at"].alias("t0"), b["at"].alias("t1"), a["weight"].alias("w0"), b["weight"].alias("w1"), ((a["weight"] + b["weight"]) / 2 * (b["at"] - a["at"])).alias("area"))

    pieces = F.transform(F.slice(padded, F.lit(1), F.size(padded) - 1), piece)

    def add(done: Column, s: Column) -> Column:
        c0 = F.coalesce(F.try_element_at(done, F.lit(-1))["c1"], F.lit(0.0))
        return F.concat(done, F.array(F.struct(s["t0"], s["t1"], s["w0"], s["w1"], c0.alias("c0"), (c0 + s["area"]).alias("c1"))))

    return F.aggregate(pieces, F.expr("cast(array() as array<struct<t0:double,t1:double,w0:double,w1:double,c0:double,c1:double>>)"), add)


def _time(segments: Column, demand: Column) -> Column:
    """The time at which the integral of the schedule reaches ``demand``."""
    found = F.coalesce(F.try_element_at(F.filter(segments, lambda s: s["c1"] > demand), F.lit(1)), F.element_at(segments, -1))

    def solve(s: Column) -> Column:
        y = demand - s["c0"]
        slope = F.coalesce(F.try_divide(s["w1"] - s["w0"], s["t1"] - s["t0"]), F.lit(0.0))
        root = F.sqrt(F.greatest(s["w0"] * s["w0"] + 2 * slope * y, F.lit(0.0)))
        return F.least(s["t0"] + F.coalesce(F.try_divide(2 * y, s["w0"] + root), F.lit(0.0)), F.lit(1.0))

    return F.element_at(F.transform(F.array(found), solve), 1)


def targets(sizes: DataFrame, schedule: DataFrame, most: float = MOST) -> DataFrame:
    """(source, source_size, target, area, segments): how many words the mix takes from each source.

    ``sizes``: source, source_size. The weights share the sum of all sizes; targets stop at ``most`` times the source's size
    and what they leave is shared again by weight, until none is above. With sources in order of size per
    weight, those that stop are the first ones, so running sums give the final share in one pass.
    """
    number = lambda c: F.greatest(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    knots = schedule.filter("at between 0 and 1").groupBy(F.col("source").alias("of")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("at").cast("double").alias("at"), number("weight").alias("weight")))).alias("knots")
    )
    joined = sizes.join(knots, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("segments", F.when(F.col("knots").isNotNull(), _segments(F.col("knots"))))
    area = F.coalesce(F.element_at("segments", -1)["c1"], F.lit(0.0))
    all_sources = materialize(joined.select("source", "source_size", area.alias("area"), (F.lit(float(most)) * F.col("source_size")).alias("stop"), "segments"), "mix-sources")
    total = all_sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double").alias("words"), F.coalesce(F.sum("area"), F.lit(0.0)).alias("area")).first()
    weighed = all_sources.filter("area > 0").select("source", "area", "stop", (F.col("stop") / F.col("area")).alias("ratio"))
    placed = running(weighed, "mix-ratios", [], ["ratio", "source"], {"stop": "__stops", "area": "__areas"})
    share = F.try_divide(F.lit(total.words) - F.col("__stops"), F.lit(total.area) - F.col("__areas"))
    level = placed.filter(F.col("area") * share <= F.col("stop")).agg(F.min_by(share, F.col("__index"))).first()[0]
    wanted = F.when(F.col("area") <= 0, F.lit(0.0)).otherwise(F.col("stop") if level is None else F.least("stop", F.col("area") * F.lit(level)))
    return all_sources.select("source", "source_size", "area", "segments", wanted.alias("target"))


def mix(docs: DataFrame, schedule: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", columns: list[str] | None = None, out: str = "mix", most: float = MOST) -> DataFrame:
    """``columns`` of ``docs`` (all, unless given) with a struct ``out``: size, source_size, target, copies, taken, positions.

    ``schedule``: source, at (0 to 1; other knots are ignored), weight (null, NaN or negative: 0); before its first and after its last knot a
    weight stays; a jump is two knots a moment apart (knots of one time go by weight); a source without knots is not taken. ``positions`` has a training position
    (0 to 1) for every copy taken, at most ``most``, rounded up; taken = copies * size. The copies of a source end
    within half a document of its target. Size: words of the text, null has none. A null source is a source. Keys may
    repeat or be null: rows alike in key, size and source share the copies due to them in an order that does
    not show in the result. A column called ``out`` is replaced; other names cannot clash. An empty table gives none.
    """
    carried = [c for c in (docs.columns if columns is None else columns) if c != out]
    row = F.struct(*[docs[c] for c in carried]).alias("row")
    code = F.md5(F.coalesce(docs[key].cast("string"), F.lit("")))
    measured = docs.select(row, docs[source].alias("source"), F.regexp_count(whole(docs[text]), F.lit(WORD)).cast("long").alias("size"), code.alias("code"))
    if text not in carried:
        measured = materialize(measured, "mix-sizes")
    sizes = measured.groupBy("source").agg(F.sum("size").alias("source_size"))
    facts = targets(sizes, schedule, most)
    placed = running(measured, "mix-order", ["source"], ["code", "size"], {"size": "before"}, facts)

    middles = F.transform(F.sequence(F.lit(0), F.lit(int(-(-most // 1)) - 1)), lambda k: k * F.col("source_size") + F.col("before") + F.col("size") / 2.0)
    due = F.filter(middles, lambda m: m < F.col("target"))
    positions = F.transform(due, lambda m: _time(F.col("segments"), m / F.col("target") * F.col("area")))
    done = placed.withColumn("positions", positions).withColumn("copies", F.size("positions"))
    result = F.struct("size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "positions")
    return done.select("row.*", result.alias(out))


def training_order(docs: DataFrame, schedule: DataFrame, position: str = "position", **how) -> DataFrame:
    """One row per copy that the mix takes, range-sorted by its training position (column ``position``)."""
    mixed = mix(docs, schedule, out="__mix", **how)
    kept = [c for c in mixed.columns if c not in ("__mix", position)]
    copies = mixed.select(*kept, F.explode("__mix.positions").alias(position))
    return copies.repartitionByRange(position).sortWithinPartitions(position)


def cycled_schedule(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, ramps: tuple[tuple[float, float], ...] = RAMPS) -> DataFrame:
    """Schedules for the distinct ``source`` values by code point, null last: weights and ramps dealt in turn.

    A ramp is the factor at the start and at the end; factors of mean 1 keep the integral at the weight.
    """
    placed = running(sources.select("source").distinct(), "mix-names", [], ["source"])
    turn = F.col("__index")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (turn % len(values) + 1).cast("int"))
    ends = [F.struct(F.lit(float(at)).alias("at"), (pick(weights) * pick([r[at] for r in ramps])).alias("weight")) for at in (0, 1)]
    return placed.select("source", F.inline(F.array(*ends)))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, range-sorted by the first training position (null: not taken)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mix(docs, cycled_schedule(docs), columns=["doc_id"])
    rows = mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", F.try_element_at("mix.positions", F.lit(1)).alias("position"))
    order = [F.col("position").asc_nulls_last(), F.col("doc_id")]  # the key spreads rows that are not taken
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


OP11_SQL = f"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS code,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, {MOST}.0::DOUBLE * CAST(sum(size) AS BIGINT) AS stop,
    CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) AS turn
  FROM d GROUP BY source
), v AS (
  SELECT *, [{", ".join(f"{w}::DOUBLE" for w in WEIGHTS)}][turn + 1] AS area,
    [{", ".join(f"{w * a}::DOUBLE" for w, (a, _) in zip(WEIGHTS, RAMPS, strict=True))}][turn + 1] AS w0,
    [{", ".join(f"{w * b}::DOUBLE" for w, (_, b) in zip(WEIGHTS, RAMPS, strict=True))}][turn + 1] AS w1
  FROM s
), r AS (
  SELECT *, row_number() OVER o AS place, sum(stop) OVER () / {MOST} AS words, sum(area) OVER () AS areas,
    coalesce(sum(stop) OVER (ORDER BY stop / area, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops_before,
    coalesce(sum(area) OVER (ORDER BY stop / area, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS areas_before
  FROM v WINDOW o AS (ORDER BY stop / area, source NULLS LAST)
), l AS (
  SELECT min_by((words - stops_before) / (areas - areas_before), place) AS level FROM r
  WHERE area * ((words - stops_before) / (areas - areas_before)) <= stop
), t AS (
  SELECT v.*, least(stop, area * level) AS target FROM v, l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.area, t.w0, t.w1,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY code, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), m AS (
  SELECT *, list_filter([CAST(k * source_size + before AS DOUBLE) + size / 2.0::DOUBLE FOR k IN [0, 1, 2]], lambda x: x < target) AS due FROM p
)
SELECT doc_id, size, source_size, target, CAST(len(due) * size AS BIGINT) AS taken,
  CASE WHEN len(due) > 0 THEN least(2 * (due[1] / target * area) / (w0 + sqrt(greatest(w0 * w0 + 2 * (w1 - w0) * (due[1] / target * area), 0))), 1) END AS position
FROM m
"""
