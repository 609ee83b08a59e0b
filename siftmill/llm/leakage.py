"""Test items inside training text: a broadcast hash set of item n-grams, scanned over every document's windows.

Words are the longest runs of a-z and 0-9 of the lower-cased text. Hashing is done on whole batches of text at once:
each word gets a polynomial hash from one pass over the bytes, each window of ``n`` words a hash of its word hashes.
Windows whose hash is in the set are compared word by word, so a hit is never a collision.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.shared import cut, spread

#: Consecutive words that make a leak.
N_WORDS = 12
#: Most bytes of one n-gram set, which every Python worker holds; more items are split and the corpus scanned once for
#: each part.
MAX_SET_BYTES = 192_000_000
#: Bytes of a set for each word of its items: window hash 8, place 4, filter 4 at most, word bounds 8.
WORD_BYTES = 24
#: Most bytes of leaked spans that are broadcast to the documents; more are joined by a shuffle.
MAX_SPAN_BYTES = 32_000_000
#: Bytes of text hashed at once.
CHUNK = 4_000_000

_P = np.uint64(0x100000001B3)
_Q = np.uint64(0x9E3779B97F4A7C15)
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(97, 123)]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), base, dtype=np.uint64)]), dtype=np.uint64)[:n]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each word in a byte array."""
    edge = np.diff(np.concatenate([[False], _IS_WORD[data], [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, the same wherever it stands: sum of byte * P^(position from the word's end)."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    length = end - start
    inside = np.repeat(np.arange(len(start)), length)
    at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    power = _powers(_P, int(length.max()))
    value = (data[start[inside] + at].astype(np.uint64) + np.uint64(1)) * power[at]
    h = np.add.reduceat(value, np.cumsum(length) - length)
    h = (h ^ (h >> np.uint64(29))) * _Q
    return h ^ (h >> np.uint64(32))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for j in range(n):
        out = out * _Q + words[j : j + m]
    return out


class NgramSet:
    """The normalised n-grams of the test items in arrays: sorted hashes, and for each the item word it begins with."""

    def __init__(self, items: list[tuple[int, bytes]], n: int = N_WORDS):
        """``items``: item id and lower-cased text; an id may come more than once, as the pieces of a long item do."""
        self.n = n
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        self.data = np.frombuffer(b"\n".join(t for _, t in items), dtype=np.uint8)
        start, end = word_spans(self.data)
        first = np.cumsum([0] + [len(t) + 1 for _, t in items])[:-1]
        windows = window_hashes(word_hashes(self.data, start, end), n)
        m = len(windows)
        self.start, self.end = start.astype(np.int32), end.astype(np.int32)
        #: number of the first word of each item; windows that run into the next item are left out
        self.first_word = np.searchsorted(start, first).astype(np.int32)
        whole = np.flatnonzero(self._item(np.arange(m)) == self._item(np.arange(m) + n - 1)) if m else np.zeros(0, dtype=np.int64)
        order = whole[np.argsort(windows[whole], kind="stable")]
        self.hashes, self.at = windows[order], order.astype(np.int32)
        # a bit table ahead of the binary search: most windows are dismissed by one lookup
        self.mask = np.uint64((1 << max(16, (len(self.hashes) * 8).bit_length())) - 1)
        bits = np.zeros(int(self.mask) + 1, dtype=bool)
        bits[(self.hashes & self.mask).astype(np.int64)] = True
        self.bits = np.packbits(bits, bitorder="little")

    def _item(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first_word, words, side="right") - 1

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.data, self.start, self.end, self.hashes, self.at, self.bits))

    def hits(self, windows: np.ndarray) -> np.ndarray:
        if not len(self.hashes) or not len(windows):
            return np.zeros(0, dtype=np.int64)
        low = (windows & self.mask).astype(np.int64)
        maybe = np.flatnonzero((self.bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1)
        at = np.minimum(np.searchsorted(self.hashes, windows[maybe]), len(self.hashes) - 1)
        return maybe[self.hashes[at] == windows[maybe]]

    def _words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
        return [data[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist())]

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """(text number, item id, first byte, last byte exclusive) of each verified window of the lower-cased texts."""
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        start, end = word_spans(data)
        windows = window_hashes(word_hashes(data, start, end), self.n)
        for w in self.hits(windows).tolist():
            doc = int(np.searchsorted(starts, start[w], side="right")) - 1
            if end[w + self.n - 1] > starts[doc + 1]:
                continue  # the window runs into the next text
            words = self._words(data, start[w : w + self.n], end[w : w + self.n])
            a, b = (int(np.searchsorted(self.hashes, windows[w], side=side)) for side in ("left", "right"))
            for v in self.at[a:b].tolist():
                if self._words(self.data, self.start[v : v + self.n], self.end[v : v + self.n]) == words:
                    yield doc, int(self.ids[self._item(v)]), int(start[w] - starts[doc]), int(end[w + self.n - 1] - starts[doc])


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield first, i
            first, size = i, 0
        size += len(t)
    if texts:
        yield first, len(texts)


def _leak_scan(grams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = grams.value
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = _lowered(batch)
            found: dict[tuple[int, int], int] = defaultdict(int)
            for a, b in _chunks(texts):
                for doc, item, _, _ in known.scan(texts[a:b]):
                    found[a + doc, item] += 1
            rows = [(ids[d], item, n) for (d, item), n in found.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["doc_id", "item_id", "windows"]
            )

    return run


def _lower_map(text: str) -> tuple[str, list[int]]:
    """Lower-cased text and, for each of its characters and its end, the character of ``text`` it comes from."""
    low = text.lower()
    if len(low) == len(text):
        return low, list(range(len(text) + 1))
    out, at = [], []
    for i, ch in enumerate(text):
        x = ch.lower()
        out.append(x)
        at += [i] * len(x)
    return "".join(out), [*at, len(text)]


def _lowered(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").lower().encode("utf-8", "replace") for t in batch.column("text").to_pylist()]


def _without(text: str, spans: list[tuple[int, int]], mark: str) -> tuple[str, int]:
    """The text without spans, given in bytes of its lower-cased form, and how many characters went."""
    low, at = _lower_map(text)
    raw = low.encode("utf-8", "replace")
    keep, last, gone = [], 0, 0
    for s, e in merge_spans(spans):
        s, e = (at[len(raw[:x].decode("utf-8", "ignore"))] for x in (s, e))
        keep += [text[last:s], mark]
        last, gone = e, gone + e - s
    return "".join(keep) + text[last:], gone


def _clean(grams, mark: str):
    """Scan and cut in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = grams.value
        for batch in batches:
            texts, lows = batch.column("text").to_pylist(), _lowered(batch)
            cuts: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for a, b in _chunks(lows):
                for doc, _, s, e in known.scan(lows[a:b]):
                    cuts[a + doc].append((s, e))
            removed = [0] * len(texts)
            for d, spans in cuts.items():
                texts[d], removed[d] = _without(texts[d], spans, mark)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], ["doc_id", "text", "chars_removed"])

    return run


def _spans(grams):
    """(key, s, e) of the merged leaked spans of each text, by the key of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = grams.value
        for batch in batches:
            keys, lows = batch.column("key").to_pylist(), _lowered(batch)
            cuts: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for a, b in _chunks(lows):
                for doc, _, s, e in known.scan(lows[a:b]):
                    cuts[a + doc].append((s, e))
            rows = [(keys[d], s, e) for d, spans in cuts.items() for s, e in merge_spans(spans)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2))], ["key", "s", "e"])

    return run


def _cut_spans(mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = batch.column("text").to_pylist(), []
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                gone = 0
                if spans:
                    texts[i], gone = _without(texts[i], [(x["s"], x["e"]) for x in spans], mark)
                removed.append(gone)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], ["doc_id", "text", "chars_removed"])

    return run


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _pieces(text: bytes, n: int, limit: int) -> Iterator[tuple[bytes, int]]:
    """The text and the bytes its set takes; a text beyond the limit in pieces that overlap by n - 1 words, so that every
    window lies in one of them."""
    start, end = word_spans(np.frombuffer(text, dtype=np.uint8))
    if len(start) < n:
        return
    size = len(text) + WORD_BYTES * len(start)
    step = len(start) if size <= limit else max(1, int(len(start) * limit / size) - n)
    for k in range(0, max(1, len(start) - n + 1), step):
        last = min(len(start), k + step + n - 1)
        part = text[start[k] : end[last - 1]]
        yield part, len(part) + WORD_BYTES * int(last - k)


def ngram_sets(spark: SparkSession, items: DataFrame, n: int = N_WORDS) -> list:
    """Broadcast n-gram sets of the items, each of at most MAX_SET_BYTES, however many or long the items are. They are
    built one after another from a streamed read; the driver holds one at a time."""
    rows = items.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    parts, part, size = [], [], 0
    for item, text in rows.toLocalIterator():
        for piece, b in _pieces(text.lower().encode("utf-8", "replace"), n, MAX_SET_BYTES):
            if part and size + b > MAX_SET_BYTES:
                parts.append(spark.sparkContext.broadcast(NgramSet(part, n)))
                part, size = [], 0
            part.append((item, piece))
            size += b
    return [*parts, spark.sparkContext.broadcast(NgramSet(part, n))]


def find_leaks(documents: DataFrame, items: DataFrame, n: int = N_WORDS) -> DataFrame:
    """(doc_id, item_id, windows): each document with each item of which it holds n consecutive words.

    Null or empty texts and items of fewer than n words have no leaks. Items that share a passage are all reported.
    Rows that repeat a doc_id are scanned each; a null doc_id stays null. Other columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    docs = spread(docs)
    found = [docs.mapInArrow(_leak_scan(g), "doc_id long, item_id long, windows long") for g in ngram_sets(docs.sparkSession, items, n)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("doc_id", "item_id").agg(F.sum("windows").alias("windows"))


def remove_leaks(documents: DataFrame, items: DataFrame, n: int = N_WORDS, mark: str = "") -> DataFrame:
    """The documents (doc_id, text, chars_removed) with every leaked span replaced by ``mark``.

    Overlapping windows are one span. Null texts stay null, texts without a leak stay as they are. A text with leaks of
    very many places holds them in one row, as it holds itself.
    """
    docs = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    parts, out = ngram_sets(docs.sparkSession, items, n), "doc_id long, text string, chars_removed long"
    if len(parts) == 1:
        return docs.mapInArrow(_clean(parts[0], mark), out)
    # several parts: each scans the text as it came, the spans of all are merged, and every text is cut once
    keyed = docs.withColumn("key", F.unhex(F.sha2("text", 256)))
    known = keyed.select("key", "text").filter("text is not null")
    found = [known.mapInArrow(_spans(g), "key binary, s long, e long") for g in parts]
    all_spans = cut(reduce(DataFrame.unionByName, found).distinct(), "leak-spans")
    spans = all_spans.df.groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    few = all_spans.rows * 64 <= MAX_SPAN_BYTES
    return keyed.join(F.broadcast(spans) if few else spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(_cut_spans(mark), out)
