"""Date expressions. ``as_of`` is always an argument; nothing reads the clock."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mentionlake import constants as C
from mentionlake.functions.scalars import literal_map
from mentionlake.functions.text import let
from mentionlake.functions.urls import path

# Zone names accepted in mail-style dates.
_ZONES = {
    "GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400",
    "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}
_MAIL_PATTERNS = [
    "d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm xx", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm", "d MMM yyyy",
    "MMM d yyyy HH:mm:ss", "MMM d yyyy", "MMMM d yyyy", "d MMMM yyyy", "M/d/yyyy HH:mm", "M/d/yyyy",
]


def as_timestamp(value) -> Column:
    """A timestamp Column from a Column, datetime or ISO text."""
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def parse_date(text: Column) -> Column:
    """ISO 8601 and mail-style dates to a timestamp; NULL when neither fits."""

    def mail(value: Column) -> Column:
        out = F.regexp_replace(value, r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", "")
        out = F.regexp_replace(F.replace(out, F.lit(","), F.lit(" ")), r"\s+", " ")
        zone = F.try_element_at(literal_map(_ZONES), F.regexp_extract(out, " ([A-Z]{1,3})$", 1))
        out = F.when(zone.isNotNull(), F.concat(F.regexp_replace(out, "[A-Z]{1,3}$", ""), zone)).otherwise(out)
        return let(out, lambda t: F.coalesce(*[F.try_to_timestamp(t, F.lit(p)) for p in _MAIL_PATTERNS]))

    def parsed(value: Column) -> Column:
        iso = F.when(value.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), value.try_cast("timestamp"))
        return F.when(F.length(value) >= 6, F.coalesce(iso, mail(value)))

    return let(F.trim(text), parsed)


def compact_date(text: Column) -> Column:
    """yyyyMMddHHmmss with or without T/Z separators; NULL when shorter than 14 characters."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.length(text) >= 14, F.try_to_timestamp(F.substring(digits, 1, 14), F.lit("yyyyMMddHHmmss")))


def _noon(year: Column, month: Column, day: Column) -> Column:
    parts = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.try_to_timestamp(F.concat(parts, F.lit(" 12:00:00")), F.lit("yyyy-MM-dd HH:mm:ss"))


def _digits(value: Column, least: int, most: int | None = None) -> Column:
    """Whether a text is that many ASCII digits; false for NULL."""
    return F.coalesce(value.rlike(rf"^[0-9]{{{least},{most or least}}}$"), F.lit(False))


def date_from_url(url: Column, as_of) -> Column:
    """Publication day written in a URL path (noon UTC), if it lies in (2000-01-01, as_of + 1 day)."""
    upper = as_timestamp(as_of) + F.expr("INTERVAL 1 DAY")
    lower = F.lit("2000-01-01 00:00:00").cast("timestamp")

    def plausible(ts: Column) -> Column:
        return F.when((ts > lower) & (ts < upper), ts)

    def days(p: Column) -> Column:
        """Per shape of path the first date written in it, read segment by segment."""
        segments = F.split(F.lower(p), "/")
        words = F.transform(segments, lambda s: F.split(s, "-"))
        triple = lambda y, m, d: F.struct(y.alias("y"), m.alias("m"), d.alias("d"))
        runs = F.transform(segments, lambda s, i: triple(s, F.get(segments, i + 1), F.get(segments, i + 2)))
        ends = F.transform(F.filter(words, lambda w: F.size(w) >= 3), lambda w: triple(*[F.element_at(w, k) for k in (-3, -2, -1)]))
        packed = F.transform(
            F.filter(F.flatten(words), lambda w: _digits(w, 8)),
            lambda w: triple(F.substring(w, 1, 4), F.substring(w, 5, 2), F.substring(w, 7, 2)),
        )
        first = lambda rows, fits: F.get(F.filter(rows, lambda r: _digits(r["y"], 4) & fits(r)), F.lit(0))
        months = literal_map(C.URL_MONTHS)
        named = first(runs, lambda r: F.map_contains_key(months, F.coalesce(r["m"], F.lit(""))))
        numeric = F.coalesce(
            first(runs, lambda r: _digits(r["m"], 1, 2) & _digits(r["d"], 1, 2)),
            first(ends, lambda r: _digits(r["m"], 2) & _digits(r["d"], 2)),
        )
        by_name = triple(named["y"], F.try_element_at(months, named["m"]).cast("string"), F.lit("15"))
        real = lambda r: r["m"].cast("int").between(1, 12) & r["d"].cast("int").between(1, 31)
        return F.array(numeric, F.when(named.isNotNull(), by_name), first(packed, real))

    def found(p: Column) -> Column:
        dates = F.transform(days(p), lambda r: plausible(_noon(r["y"], r["m"], r["d"])))
        return F.get(F.filter(dates, lambda t: t.isNotNull()), F.lit(0))

    return let(path(url), lambda p: F.when(p.rlike(r"\d{4}"), found(p)))


def age_days(ts: Column, as_of) -> Column:
    """Fractional age in days, to the microsecond."""
    return (F.unix_micros(as_timestamp(as_of)) - F.unix_micros(ts)) / F.lit(86_400_000_000)


def days_before(as_of, days: int) -> Column:
    return as_timestamp(as_of) - F.make_dt_interval(F.lit(days))


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")
