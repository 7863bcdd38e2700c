"""String expressions: markup removal, entity decoding, normalised text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The named entities that are decoded, in order.
NAMED_ENTITIES = [("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " ")]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it.

    Nested string rules mention their input several times; without this the
    optimizer would expand an expensive input at every mention.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _code_point(n: Column) -> Column:
    """One character from a code point held as bigint."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def _numeric_entities(text: Column, pattern: str, base: int, prefix: str) -> Column:
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))

    def replace_one(acc: Column, code: Column) -> Column:
        n = F.try_to_number(F.conv(code, base, 10), F.lit("999999999")).cast("bigint")
        legal = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
        return F.when(legal, F.replace(acc, F.concat(F.lit(prefix), code, F.lit(";")), _code_point(n))).otherwise(acc)

    return F.aggregate(codes, text, replace_one)


def decode_entities(text: Column) -> Column:
    """Decimal, hexadecimal and six named entities; text without '&' is returned as is."""

    def numeric(t: Column) -> Column:
        decimal = _numeric_entities(t, r"&#(\d{1,7});", 10, "&#")
        return let(decimal, lambda x: _numeric_entities(x, r"&#x([0-9a-fA-F]{1,6});", 16, "&#x"))

    def decoded(t: Column) -> Column:
        out = F.when(F.contains(t, F.lit("&#")), numeric(t)).otherwise(t)
        for name, char in NAMED_ENTITIES:
            out = F.regexp_replace(out, f"(?i)&{name};", char)
        return F.when(F.contains(t, F.lit("&")), out).otherwise(t)

    return let(text, decoded)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_markup(text: Column) -> Column:
    """Tags to spaces, entities decoded, white space collapsed."""
    return collapse(decode_entities(F.regexp_replace(text, "<[^>]+>", " ")))


def normalized(text: Column) -> Column:
    """Lower-case letters and digits separated by single spaces (any script)."""
    return F.trim(F.regexp_replace(F.lower(strip_markup(text)), r"[^\p{L}\p{N}]+", " "))


def normalized_plain(text: Column) -> Column:
    """As ``normalized`` for text that holds no markup."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def joined_lower(*cols: Column) -> Column:
    """Lower-case concatenation with single spaces; NULL parts count as empty."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols]))


def first_non_empty(*cols: Column) -> Column:
    """First value that is neither NULL nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def xml_tag(block: Column, tag: str) -> Column:
    """Trimmed body of the first ``<tag>`` with CDATA unwrapped, or ''."""
    pattern = rf"(?is)<{tag}[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{tag}>"
    return F.trim(F.coalesce(F.regexp_extract(block, pattern, 1), F.lit("")))


def xml_text(block: Column, tag: str) -> Column:
    """CDATA body as is, otherwise the body without nested tags; NULL when empty."""
    cdata = F.regexp_extract(block, rf"(?is)<{tag}[^>]*><!\[CDATA\[(.*?)\]\]></{tag}>", 1)
    plain = F.trim(F.regexp_replace(F.regexp_extract(block, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]+>", ""))
    return F.when(F.length(cdata) > 0, F.trim(cdata)).otherwise(F.nullif(plain, F.lit("")))


def xml_attr(block: Column, tag: str, attr: str) -> Column:
    value = F.regexp_extract(block, rf'(?is)<{tag}[^>]*\s{attr}="([^"]*)"', 1)
    return F.nullif(value, F.lit(""))


def split_publisher(title: Column) -> tuple[Column, Column]:
    """(headline, publisher) split at the last ' - ', unless that is at index 0."""
    pattern = r"(?s)^(.+) - (.*)$"
    hit = title.rlike(pattern)
    headline = F.when(hit, F.trim(F.regexp_extract(title, pattern, 1))).otherwise(title)
    publisher = F.when(hit, F.trim(F.regexp_extract(title, pattern, 2))).otherwise(F.lit(""))
    return headline, publisher


def title_words(title: Column) -> Column:
    """Distinct words longer than three characters, ASCII letters and digits only."""
    cleaned = F.trim(F.regexp_replace(F.lower(title), r"[^a-z0-9\s]", ""))
    words = F.filter(F.split(cleaned, r"\s+"), lambda w: F.length(w) > 3)
    return F.array_distinct(F.coalesce(words, F.array().cast("array<string>")))


def quoted(text: Column) -> Column:
    """The text as a literal inside a regular expression, also if it holds the closing mark itself."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
