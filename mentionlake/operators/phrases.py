"""Dictionary matching by equi-joins on whole phrases, for dictionaries of any size.

Texts stay where they are read. A sieve, one byte for each of ``SLOTS`` hash values of a dictionary piece, is
compiled into the scan; only pieces of text that pass it leave their task, as (row identity, phrase). A row is
known by its key and the digest of its text.

* ``word_pairs``: text and terms are cut into tokens, ASCII word runs and single other characters, so a term
  occurs between word boundaries exactly when its tokens stand in a row and no run touches its ends. The n-grams that
  begin with a term's first token, in the lengths of such terms, are joined with the dictionary.
* ``substring_pairs``: a term without white space lies inside one token; a longer one has a piece inside a token and its whole
  occurrence within reach of it. The corpus' distinct tokens are resolved to dictionary pieces once; then only
  resolved tokens leave the scan, with their surroundings if a longer term needs them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mentionlake.session import stored

SLOTS = 1 << 18
#: Word runs, or any other single character.
TOKEN = r"[a-z0-9_]+|[^a-z0-9_]"
#: Words and the white space between them.
PIECE = r"\S+|\s+"


def _slot(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(SLOTS))


class Sieve:
    """Which marks (bits) the pieces of a dictionary that share a hash slot carry. At most ``SLOTS`` numbers reach the driver."""

    def __init__(self, pieces: DataFrame):
        """``pieces``: piece, mark (1 to 255)."""
        found = pieces.groupBy(_slot(F.col("piece")).alias("slot")).agg(F.bit_or("mark").alias("mark")).toArrow().to_pydict()
        table = bytearray(SLOTS)
        for slot, mark in zip(found["slot"], found["mark"], strict=True):
            table[slot] = mark
        self.table = F.lit(table)

    def _byte(self, piece: Column) -> Column:
        return F.substring(self.table, (_slot(piece) + 1).cast("int"), F.lit(1))

    def passes(self, piece: Column) -> Column:
        return self._byte(piece) != F.lit(bytearray(1))

    def marks(self, piece: Column) -> Column:
        return F.conv(F.hex(self._byte(piece)), 16, 10).cast("int")


def _places(tokens: Column, test) -> Column:
    """Places (from 1) of the tokens that pass ``test``."""
    places = F.when(F.size(tokens) > 0, F.sequence(F.lit(1), F.size(tokens)))
    return F.filter(places, lambda i: test(F.element_at(tokens, i)))


def _run(tokens: Column, place: Column) -> Column:
    return F.coalesce(F.get(tokens, place - 1).rlike("^[a-z0-9_]"), F.lit(False))


def word_pairs(rows: DataFrame, terms: DataFrame, ids: list[str], hay: str) -> DataFrame:
    """(ids, keyword), not distinct: every term found between word boundaries. ``hay`` is lower-case text; ``terms``: keyword, phrase (lower-case)."""
    cut = F.regexp_extract_all("phrase", F.lit(TOKEN), F.lit(0))
    entries = stored(terms.select("keyword", "phrase", F.size(cut).alias("k"), F.element_at(cut, 1).alias("head")).distinct(), "phrases")
    lengths = sorted(r.k for r in entries.select("k").distinct().collect())  # as many as lengths of terms
    # Lengths beyond the seventh share one bit of the sieve.
    bit_of = {k: 1 << min(n, 7) for n, k in enumerate(lengths)}
    bit = F.lit(0)
    for k, b in bit_of.items():
        bit = F.when(F.col("k") == k, b).otherwise(bit)
    sieve = Sieve(entries.select(F.col("head").alias("piece"), bit.alias("mark")))

    tokens = F.col("__tokens")
    cut_rows = rows.select(*ids, F.explode(F.array(F.regexp_extract_all(hay, F.lit(TOKEN), F.lit(0)))).alias("__tokens"))

    def phrases(i: Column) -> Column:
        marks = sieve.marks(F.element_at(tokens, i))
        found = [
            F.when((marks.bitwiseAND(F.lit(b)) != 0) & (i + (k - 1) <= F.size(tokens)) & ~_run(tokens, i + k), F.array_join(F.slice(tokens, i, F.lit(k)), ""))
            for k, b in bit_of.items()
        ]
        return F.when(_run(tokens, i - 1) & ~_run(tokens, i), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*found)))

    # A run that follows a term's last run would be part of it; the first token of a term after a run is no run.
    spots = _places(tokens, sieve.passes)
    phrase = F.explode(F.array_distinct(F.flatten(F.transform(spots, phrases))))
    return cut_rows.select(*ids, phrase.alias("phrase")).join(entries.select("phrase", "keyword"), "phrase").select(*ids, "keyword")


def _grams(token: Column) -> Column:
    """Distinct character grams of one, two and three characters."""
    return F.array_distinct(
        F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.length(token)),
                lambda i: F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.substr(token, i, n)),
            )
        )
    )


def _rarest_anchor(terms: DataFrame, pieces: Column) -> DataFrame:
    """Attach to each term the piece shared by the fewest terms (longest on ties)."""
    exploded = terms.select("*", F.explode(pieces).alias("piece"))
    counts = exploded.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct("n", (-F.length("piece")).alias("neg_len"), "piece"))
    return exploded.join(counts, "piece").groupBy("keyword", "phrase").agg(best["piece"].alias("anchor"))


def substring_pairs(rows: DataFrame, terms: DataFrame, ids: list[str], hay: str) -> DataFrame:
    """(ids, keyword), not distinct: every term that is a substring of ``hay``. ``terms``: keyword, phrase."""
    words = lambda c: F.filter(F.regexp_extract_all(c, F.lit(PIECE), F.lit(0)), lambda t: ~t.rlike(r"^\s"))
    anchored = _rarest_anchor(terms.distinct(), words("phrase")).withColumn("gram", F.substring("anchor", 1, 3))
    pieces = F.regexp_extract_all(hay, F.lit(PIECE), F.lit(0))
    vocabulary = rows.select(F.explode(F.array_distinct(words(hay))).alias("token")).distinct()
    resolved = (
        vocabulary.select("token", F.explode(_grams(F.col("token"))).alias("gram")).join(anchored, "gram").filter(F.contains("token", "anchor"))
        .select("token", "keyword", "phrase", (F.col("phrase") == F.col("anchor")).alias("sure"))
    )
    resolved = stored(resolved, "resolved-tokens")
    sieve = Sieve(resolved.select(F.col("token").alias("piece"), F.when(F.col("sure"), 1).otherwise(2).alias("mark")))
    reach = anchored.agg(F.max(F.size(F.regexp_extract_all("phrase", F.lit(PIECE), F.lit(0)))).alias("n")).first().n or 0

    tokens = F.col("__tokens")
    cut_rows = rows.select(*ids, F.explode(F.array(pieces)).alias("__tokens"))

    def spot(i: Column) -> Column:
        token = F.element_at(tokens, i)
        around = F.array_join(F.slice(tokens, F.greatest(i - reach, F.lit(1)), F.lit(2 * reach + 1)), "")
        return F.struct(token.alias("token"), F.when(sieve.marks(token) >= 2, around).alias("around"))

    spots = F.explode(F.array_distinct(F.transform(_places(tokens, sieve.passes), spot)))
    met = cut_rows.select(*ids, spots.alias("spot")).select(*ids, "spot.*").join(resolved, "token")
    return met.filter(F.col("sure") | F.contains("around", "phrase")).select(*ids, "keyword")
