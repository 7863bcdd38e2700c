"""Byte-pair encoding and decoding (operator 2) and the coder that token counting (operator 5) shares.

A coder is made from the JSON of a public BPE tokenizer. A text is cut at the special
strings, then into pre-tokens. The pre-tokens of a block that the worker has not met yet
are encoded together: a pair occurrence index maps every adjacent pair to all its positions
in the block, ranks that occur are taken in ascending order, and each merge updates the
lists of the neighbouring pairs only.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import defaultdict
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import unicodedata
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.llm.common import ship, slices, table, whole

#: Pre-tokens a worker remembers; beyond it the memory starts anew. Speed only.
CACHE_ENTRIES = 300_000
#: Bytes of text that a worker codes at once.
PORTION_BYTES = 4_000_000
SHIFT = 20
GAP, DEAD = -1, -2

# The pre-token pattern of the byte-level vocabulary.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@cache
def _members(kind: str) -> str:
    """The characters of a regex class up to U+FFFF, as ranges that stand between brackets."""
    inside = regex.compile(kind).fullmatch
    found = np.fromiter((inside(chr(i)) is not None for i in range(0x10000)), bool, 0x10000)
    edges = np.flatnonzero(np.diff(found, prepend=False, append=False)).tolist()
    return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in zip(edges[::2], edges[1::2], strict=True))


def finder(pattern: str) -> Callable[[str], list[str]]:
    """``findall`` of a pattern of the regex module. Texts without characters beyond U+FFFF go to the
    standard module, which takes half the time once the classes are spelled out."""
    every = regex.compile(pattern).findall
    if "(?i" in pattern or re.search(r"\\(?!p\{[LN]\}|[sS|])", pattern) or re.search(r"\[[^]]*\\S", pattern):
        return every
    spelled, depth = [], 0
    for part in re.findall(r"\\p\{[LN]\}|\\.|.", pattern, re.S):
        depth += (part == "[") - (part == "]")
        kind = part.lower() if part == "\\S" else part
        if kind == "\\s" or kind.startswith("\\p"):
            part = _members(kind) if depth else f"[{'^' if part == '\\S' else ''}{_members(kind)}]"
        spelled.append(part)
    low = re.compile("".join(spelled)).findall
    beyond = re.compile("[\U00010000-\U0010ffff]").search
    return lambda text: low(text) if text.isascii() or not beyond(text) else every(text)


class Coder:
    """Encodes texts by a tokenizer file of the byte-level BPE family."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.first = np.array([vocab[letters[b]] for b in range(256)])
        self.last = np.array([vocab[letters[b] + suffix] for b in range(256)])
        merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            merges.setdefault(vocab[a] << SHIFT | vocab[b], (rank, vocab[a + b]))
        keys = sorted(merges)
        self.keys = np.array(keys, np.int64)
        self.ranks = [merges[k][0] for k in keys]
        self.results = [merges[k][1] for k in keys]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.lower = "Lowercase" in kinds
        self.nfc = "NFC" in kinds
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        split = next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), BYTE_LEVEL)
        self.find = finder(split)
        letter_bytes = {c: b for b, c in letters.items()}
        self.bytes_of = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in vocab.items():
            body = token[: -len(suffix)] if suffix and token.endswith(suffix) else token
            self.bytes_of[i] = bytes(letter_bytes[c] for c in body)
        for token, i in special.items():
            self.bytes_of[i] = token.encode()
        self.pieces = pa.array(self.bytes_of, pa.large_binary())
        self.cache: dict[str | int, bytes] = {}

    def normal(self, text: str) -> str:
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            # One character at a time: no special form for a sigma at a word's end.
            text = text.replace("Σ", "σ").lower()
        return text

    def pretokens(self, text: str) -> list[str | int]:
        """The pre-tokens of a text; a special string is given as its id."""
        if self.cut is None or "<|" not in text:
            return self.find(self.normal(text))
        out: list[str | int] = []
        for i, part in enumerate(self.cut.split(text)):
            if i % 2:
                out.append(self.special[part])
            elif part:
                out.extend(self.find(self.normal(part)))
        return out

    def merge(self, words: list[str]) -> list[bytes]:
        """The token ids of each word as int32 bytes; all words of the block are merged together."""
        sizes = np.fromiter((len(w.encode()) for w in words), np.int64, len(words))
        raw = np.frombuffer("".join(words).encode(), np.uint8)
        ends = np.cumsum(sizes + 1) - 1  # a gap follows each word
        symbols = np.full(int(ends[-1]) + 1 if len(words) else 0, GAP, np.int64)
        inside = np.ones(len(symbols), bool)
        inside[ends] = False
        symbols[inside] = self.first[raw]
        symbols[ends - 1] = self.last[raw[np.cumsum(sizes) - 1]]
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        index: dict[int, list[np.ndarray]] = {}
        active: list[tuple[int, int]] = []

        def note(pairs: np.ndarray, at: np.ndarray) -> None:
            """Add occurrences of pairs that can merge to the index, rank by rank."""
            slot = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
            known = self.keys[slot] == pairs
            slot, at = slot[known], at[known]
            order = np.argsort(slot, kind="stable")
            slot, at = slot[order], at[order]
            cuts = np.flatnonzero(np.diff(slot)) + 1
            for i, part in zip(slot[np.concatenate(([0], cuts))].tolist() if len(slot) else [], np.split(at, cuts), strict=False):
                if i in index:
                    index[i].append(part)
                else:
                    index[i] = [part]
                    heapq.heappush(active, (self.ranks[i], i))

        touching = np.flatnonzero(inside[:-1] & inside[1:])
        note(symbols[touching] << SHIFT | symbols[touching + 1], touching)
        while active:
            _, slot = heapq.heappop(active)
            lists = index.pop(slot)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            left, right = self.keys[slot] >> SHIFT, self.keys[slot] & ((1 << SHIFT) - 1)
            at = at[symbols[at] == left]
            second = after[at]
            at = at[symbols[second] == right]
            if left == right:  # of overlapping occurrences the leftmost merges
                free, keep = -1, []
                for i, j in zip(at.tolist(), after[at].tolist(), strict=True):
                    if i != free:
                        keep.append(i)
                        free = j
                at = np.array(keep, np.int64)
            if not len(at):
                continue
            second, merged = after[at], self.results[slot]
            third, prior = after[second], before[at]
            symbols[at], symbols[second] = merged, DEAD
            after[at], before[third] = third, at
            follow, lead = symbols[third], np.where(prior >= 0, symbols[prior], GAP)
            right_ok, left_ok = follow >= 0, lead >= 0
            note(
                np.concatenate((merged << SHIFT | follow[right_ok], lead[left_ok] << SHIFT | merged)),
                np.concatenate((at[right_ok], prior[left_ok])),
            )
        left_over = np.flatnonzero(symbols >= 0)
        counts = np.diff(np.searchsorted(left_over, np.concatenate(([0], ends + 1))))
        ids = symbols[left_over].astype(np.int32).tobytes()
        cuts = (np.concatenate(([0], np.cumsum(counts))) * 4).tolist()
        return [ids[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    def learn(self, words: list[str | int]) -> list[bytes]:
        """The ids of each pre-token, as int32 bytes; those the worker has not met are merged now."""
        cache = self.cache
        new = [w for w in words if w not in cache]
        if len(cache) + len(new) > CACHE_ENTRIES:
            cache.clear()
            new = words
        plain = [w for w in new if isinstance(w, str)]
        cache.update(zip(plain, self.merge(plain), strict=True))
        cache.update((w, np.int32(w).tobytes()) for w in new if not isinstance(w, str))
        return [cache[w] for w in words]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        seen: defaultdict[str | int, int] = defaultdict()
        seen.default_factory = seen.__len__
        number = seen.__getitem__
        cut = []
        for text in texts:
            words = self.pretokens(text)
            cut.append(np.fromiter(map(number, words), np.int32, len(words)))
        parts = self.learn(list(seen))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        starts = np.cumsum(sizes) - sizes
        ids = np.frombuffer(b"".join(parts), np.int32)
        out, counts = [], np.zeros(len(texts), np.int64)
        for i, words in enumerate(cut):
            each = sizes[words]
            counts[i] = total = int(each.sum())
            shift = np.repeat(starts[words] - (np.cumsum(each) - each), each)
            out.append(ids[shift + np.arange(total)])
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), counts

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def decode_all(self, ids: pa.Array, counts: np.ndarray) -> pa.Array:
        """The texts of all ids in a row, ``counts`` of them each."""
        bodies = self.pieces.take(ids)
        ends = np.concatenate(([0], np.cumsum(pc.binary_length(bodies).to_numpy())))[np.concatenate(([0], np.cumsum(counts)))]
        texts = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), bodies.buffers()[2] or pa.py_buffer(b"")])
        try:
            return texts.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # ids that do not come from a text may cut a character
            return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())


_CODERS: dict[int, Coder] = {}


def worker_coder(spec: Broadcast) -> Coder:
    """The worker's coder for a broadcast tokenizer file; kept between batches and tasks."""
    text = spec.value
    key = hash(text)
    if key not in _CODERS:
        _CODERS[key] = Coder(text)
    return _CODERS[key]


def tokenizer_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encoder(spark: SparkSession, path: str):
    """A function of a text column that gives its token ids as array<int>; null gives an empty array."""
    spec = ship(spark).sparkContext.broadcast(tokenizer_text(path))

    @F.arrow_udf("array<int>")
    def encode(column: pa.Array) -> pa.Array:
        coder = worker_coder(spec)
        ids, counts = coder.encode([t or "" for t in column.to_pylist()])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids))

    return encode


def decoder(spark: SparkSession, path: str):
    """A function of an array<int> column of token ids that gives the text; null gives an empty text."""
    spec = ship(spark).sparkContext.broadcast(tokenizer_text(path))

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        coder = worker_coder(spec)
        return coder.decode_all(column.flatten(), pc.list_value_length(column).fill_null(0).to_numpy())

    return decode


def encode_documents(docs: DataFrame, path: str, text: str | Column = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of the whole text in column ``ids`` (replaced if it exists).

    A null or empty text has no tokens. Special strings inside a text are one token each.
    Rows are independent: no shuffle, repeated rows give repeated results, an empty table an empty one.
    A decoder of that column in the same plan would encode the text once more: see ``round_trip_documents``.
    """
    return docs.withColumn(ids, encoder(docs.sparkSession, path)(whole(text)))


def decode_documents(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the decoded text of the token ids in column ``text`` (replaced if it exists)."""
    return docs.withColumn(text, decoder(docs.sparkSession, path)(F.col(ids)))


def round_trip_documents(docs: DataFrame, path: str, text: str | Column = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the token ids of the whole text and the text these decode to; each text is encoded once.

    Texts are coded in portions, so that a worker's memory does not depend on the batches it gets.
    """
    spec = ship(docs.sparkSession).sparkContext.broadcast(tokenizer_text(path))

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def recode(column: pa.Array) -> pa.Array:
        coder = worker_coder(spec)
        lists, texts = [], []
        for i, j in slices(pc.binary_length(column).fill_null(0).to_pylist(), PORTION_BYTES):
            found, counts = coder.encode([t or "" for t in column[i:j].to_pylist()])
            lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(found)))
            texts.append(coder.decode_all(lists[-1].values, counts))
        both = [pa.concat_arrays(x) if x else pa.array([], t) for x, t in ((lists, pa.list_(pa.int32())), (texts, pa.string()))]
        return pa.StructArray.from_arrays(both, ["ids", "decoded"])

    coded = recode(whole(text))
    return docs.withColumns({ids: coded["ids"], decoded: coded["decoded"]})


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of every document, as digests."""
    path = default_path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = round_trip_documents(docs, path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
