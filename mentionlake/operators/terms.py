"""Counts of words and word pairs per label over a corpus.

A term is a word of four or more letters or two such words in a row. While they are counted, terms are 64-bit keys: a task
counts its articles' keys in arrays, only (label, key, number) is shuffled, and texts of terms are read again for the few
keys that a caller wants. Two terms with one key would be counted together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

#: The label that every article has, and the term that stands for the article itself.
ALL = 0
#: Labels are known by what ``F.xxhash64`` gives for them, which takes this seed.
SEED = 42
#: Keys that a task holds before it counts them.
HELD = 1_000_000
#: Places of the table that keeps unwanted terms in the scan.
SLOTS = 1 << 20
#: Words whose keys a task remembers, and terms it has already named.
KNOWN = 150_000


def _coder() -> Callable[[list[str]], np.ndarray]:
    """A function from words to the keys of the words and then of their pairs; it is sent to the workers by value."""
    most, factor = KNOWN, np.uint64(0x9E3779B97F4A7C15)

    class Keys(dict):
        def __missing__(self, word):
            self[word] = value = xxhash.xxh64_intdigest(word)
            return value

    known = Keys()

    def keys(words):
        if len(known) > most:
            known.clear()
        one = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        return np.concatenate((one, one[:-1] * factor + one[1:])).view(np.int64)

    return keys


def label_counts(articles: DataFrame) -> DataFrame:
    """(label, term, n) to be summed: how many articles with the label hold the term.

    ``articles``: text (normalised words with single spaces; a null counts nowhere) and labels (array<string>; null and empty
    ones do not count). ``label`` is a label's ``F.xxhash64``. Each article also counts under the label ALL, and under the
    term 0 with each of its labels.
    """
    keys, most, seed = _coder(), HELD, SEED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, numbers = {}, 0, {}

        def number(label: str) -> int:
            if label not in numbers:
                numbers[label] = (xxhash.xxh64_intdigest(label, seed) + (1 << 63)) % (1 << 64) - (1 << 63)
            return numbers[label]

        def counted():
            for label, parts in held.items():
                term, count = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(term), label, np.int64)), pa.array(term), pa.array(count.astype(np.int64))], ["label", "term", "n"])

        for batch in batches:
            for text, labels in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None:
                    continue
                terms = np.unique(np.append(keys([w for w in text.split(" ") if len(w) > 3]), 0))
                for label in (0, *{number(x) for x in labels or () if x}):
                    held.setdefault(label, []).append(terms)
                    n += len(terms)
                if n > most:
                    yield from counted()
                    held, n, numbers = {}, 0, {}
        yield from counted()

    return articles.select("text", "labels").mapInArrow(run, "label long, term long, n long")


def keys_of(terms: Column) -> Column:
    """The keys of terms given as text: of one word, of two words with a space between; other text gets no term's key but null."""
    keys = _coder()

    @F.arrow_udf("long")
    def run(column: pa.Array) -> pa.Array:
        out = []
        for text in column.to_pylist():
            words = (text or "").split(" ")
            out.append(int(keys(words)[-1]) if len(words) < 3 and all(words) else None)
        return pa.array(out, pa.int64())

    return run(terms)


def named(articles: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, name) of the keys in ``wanted`` (term), from a second reading of the texts. A table of at most ``SLOTS``
    bits reaches the driver and the workers; what passes it is joined with ``wanted``."""
    slots = wanted.select(F.col("term").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")).distinct().toArrow().column(0).to_numpy()
    table = np.zeros(SLOTS, bool)
    table[slots] = True
    sent = articles.sparkSession.sparkContext.broadcast(table)
    keys, size, most = _coder(), SLOTS - 1, KNOWN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = sent.value, set()
        for batch in batches:
            terms, names = [], []
            for text in batch.column(0).to_pylist():
                words = [w for w in (text or "").split(" ") if len(w) > 3]
                found = keys(words)
                for i in table[found & size].nonzero()[0].tolist():
                    key = int(found[i])
                    if key not in seen:
                        seen.add(key)
                        terms.append(key)
                        names.append(words[i] if i < len(words) else f"{words[i - len(words)]} {words[i - len(words) + 1]}")
            if len(seen) > most:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(names, pa.string())], ["term", "name"])

    found = articles.select("text").mapInArrow(run, "term long, name string")
    return found.join(wanted.select("term").distinct(), "term", "left_semi").distinct()
