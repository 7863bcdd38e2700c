"""Numeric and array helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def round_half_up(x: Column) -> Column:
    """Nearest integer, halves towards +infinity (so -2.5 gives -2)."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def percent(part: Column, whole: Column) -> Column:
    """Whole-number percentage; 0 when there is nothing to divide by."""
    return F.when(whole > 0, round_half_up(part / whole * 100)).otherwise(F.lit(0).cast("bigint"))


def trend_pct(cur: Column, prev: Column) -> Column:
    """Absolute whole-number change against the previous period; 0 when that is 0."""
    return F.abs(_signed_pct(cur, prev))


def trend_dir(cur: Column, prev: Column) -> Column:
    pct = _signed_pct(cur, prev)
    return F.when(pct > 0, "up").when(pct < 0, "down").otherwise("flat")


def _signed_pct(cur: Column, prev: Column) -> Column:
    change = round_half_up((cur - prev) / F.nullif(prev, F.lit(0)) * 100)
    return F.coalesce(change, F.lit(0).cast("bigint"))


def band_label(score: Column) -> Column:
    """Relevance band of a score in [0, 1]."""
    return (
        F.when(score >= 0.8, "high").when(score >= 0.5, "medium").when(score >= 0.2, "low").when(score.isNotNull(), "noise")
    )


def lower_array(values: Column) -> Column:
    return F.transform(values, lambda v: F.lower(v))


def sql_literal(value) -> str:
    """SQL text of a constant. Large constants are parsed from one text: building
    them value by value costs a driver round trip each."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_table(spark, columns: str, rows) -> DataFrame:
    """A small constant table; ``columns`` is DDL. Planned as local data, no job needed to read it."""

    def text(value) -> str:
        if isinstance(value, (list, tuple)):
            return "array(" + ", ".join(text(v) for v in value) + ")"
        return sql_literal(value)

    names = [c.strip().split(" ", 1) for c in columns.split(",")]
    body = ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)
    casts = ", ".join(f"cast({n} AS {t}) AS {n}" for n, t in names)
    return spark.sql(f"SELECT {casts} FROM VALUES {body} AS t({', '.join(n for n, _ in names)})")


def literal_strings(values) -> Column:
    """A constant string array (empty lists keep their element type)."""
    return F.expr("cast(array(" + ", ".join(sql_literal(v) for v in values) + ") AS array<string>)")


def literal_map(mapping: dict) -> Column:
    """A constant map."""
    return F.expr("map(" + ", ".join(f"{sql_literal(k)}, {sql_literal(v)}" for k, v in mapping.items()) + ")")


def count_if(cond: Column) -> Column:
    """Rows for which ``cond`` is true, as bigint."""
    return F.count(F.when(cond, F.lit(1)))
