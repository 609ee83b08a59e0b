"""Content hashes, MinHash signatures and image difference hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTIAL_BYTES = 4096
PERMUTATIONS = 128
# The modulus of the hash family, the seed of its coefficients and the signature of no shingles.
MODULUS = 4294967311
SEED = 0xDEADBEEF
NOTHING = 2**63 - 1


def partial_hash(content: Column) -> Column:
    return F.sha2(F.substring(content, 1, PARTIAL_BYTES), 256)


def full_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def shingle_hash(shingle: Column) -> Column:
    """31-polynomial over the characters, as an unsigned 32-bit number."""
    chars = F.filter(F.split(shingle, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(F.lit(0xFFFFFFFF)))


def coefficients(n: int = PERMUTATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """a and b of h(x) = (a x + b) mod MODULUS, drawn in turn from a 48-bit linear congruential generator, each below
    2^31 - 1; a is one more than its draw."""
    bound, state = 2**31 - 1, (seed ^ 0x5DEECE66D) & (2**48 - 1)

    def draw() -> int:
        nonlocal state
        while True:
            state = (state * 0x5DEECE66D + 0xB) & (2**48 - 1)
            bits = state >> 17
            if bits - bits % bound + bound - 1 < 2**31:
                return bits % bound

    pairs = [(draw() + 1, draw()) for _ in range(n)]
    return np.array([a for a, _ in pairs], dtype=np.int64), np.array([b for _, b in pairs], dtype=np.int64)


_A, _B = coefficients()


_POWERS = np.cumprod(np.concatenate([[1], np.full(63, 31)]).astype(np.uint32), dtype=np.uint32)


def _powers(n: int) -> np.ndarray:
    """31^0 .. 31^(n-1) modulo 2^32."""
    return _POWERS[:n] if n <= len(_POWERS) else np.cumprod(np.concatenate([[1], np.full(n - 1, 31)]).astype(np.uint32), dtype=np.uint32)


def shingle_values(text: str) -> np.ndarray:
    """Hashes of the shingles of one text that is normalised already (words of a-z and 0-9 with single blanks)."""
    data = np.frombuffer(text.encode("ascii"), dtype=np.uint8)
    if not len(data):
        return np.zeros(1, dtype=np.int64)
    blanks = np.flatnonzero(data == 32)
    start, end = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(data)]])
    length = end - start
    place = np.repeat(end, length + (np.arange(len(end)) < len(end) - 1))[: len(data)] - np.arange(len(data)) - 1  # -1 at blanks
    power = _powers(int(length.max()) + 1)
    value = np.where(data == 32, np.uint32(0), data.astype(np.uint32) * power[np.maximum(place, 0)])
    words = np.add.reduceat(value, start, dtype=np.uint32)
    if len(words) == 1:
        return words.astype(np.int64)
    tail = power[length[1:]]
    return ((words[:-1] * np.uint32(31) + np.uint32(32)) * tail + words[1:]).astype(np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def minhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Signature of each normalised text (null: no shingles at all, so all positions are the largest number)."""
    for batch in texts:
        out = []
        for t in batch:
            if t is None:
                out.append(np.full(PERMUTATIONS, NOTHING, dtype=np.int64))
                continue
            x = shingle_values(t)
            low = np.full(PERMUTATIONS, NOTHING, dtype=np.int64)
            for k in range(0, len(x), 4096):  # long texts in parts
                low = np.minimum(low, ((x[k : k + 4096, None] * _A + _B) % MODULUS).min(axis=0))
            out.append(low)
        yield pd.Series(out)


def signature(text: Column) -> Column:
    from siftmill.functions.columns import normalise_text

    blank = text.isNull() | (F.trim(text, F.lit(" \t\n\r\f\x0b")) == "")
    return minhash(F.when(~blank, normalise_text(text)))


def signature_bytes(sig: Column) -> Column:
    """A signature as 1,024 bytes, each number in eight, the highest first."""
    return F.unhex(F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def signature_numbers(data: Column) -> Column:
    """The numbers of a signature of 1,024 bytes."""
    at = F.sequence(F.lit(0), F.lit(PERMUTATIONS - 1))
    return F.transform(at, lambda k: F.conv(F.hex(F.substring(data, k * 8 + 1, F.lit(8))), 16, -10).cast("decimal(20,0)").cast("long"))


def minhash_similarity(a: Column, b: Column) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return same / F.lit(float(PERMUTATIONS))


def dhash_similarity(a: Column, b: Column) -> Column:
    """1 - share of differing bits of two 8-byte fingerprints; 0 for missing ones or other lengths."""
    number = lambda c: F.conv(F.hex(c), 16, -10).cast("decimal(20,0)").cast("long")
    same = 1 - F.bit_count(number(a).bitwiseXOR(number(b))) / F.lit(64.0)
    return F.when((F.octet_length(a) == 8) & (F.octet_length(b) == 8), same).otherwise(F.lit(0.0))


def equality_similarity(a: Column, b: Column) -> Column:
    """1 for equal, 0 for different or missing contents."""
    return F.when(a == b, F.lit(1.0)).otherwise(F.lit(0.0))


def dhash_pixels(pixels: np.ndarray) -> bytes:
    """Difference hash of an h x w x 3 (blue, green, red) image: bilinear 9 x 8, luma, bit set where left > right."""
    h, w = pixels.shape[:2]
    ys, xs = (np.arange(8) + 0.5) * h / 8 - 0.5, (np.arange(9) + 0.5) * w / 9 - 0.5
    ys, xs = np.clip(ys, 0, h - 1), np.clip(xs, 0, w - 1)
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (ys - y0)[:, None, None], (xs - x0)[None, :, None]
    p = pixels.astype(float)
    small = (p[y0][:, x0] * (1 - fy) + p[y1][:, x0] * fy) * (1 - fx) + (p[y0][:, x1] * (1 - fy) + p[y1][:, x1] * fy) * fx
    b, g, r = (np.floor(small[..., k] + 0.5).astype(int) for k in range(3))
    luma = (r * 299 + g * 587 + b * 114) // 1000
    return np.packbits(luma[:, :-1] > luma[:, 1:], axis=1).tobytes()


@F.pandas_udf(T.BinaryType())
def image_dhash(image: pd.DataFrame) -> pd.Series:
    """Fingerprints of rows of Spark's image source; null for images under 1,024 pixels or undecoded ones."""
    out = []
    for h, w, c, data in zip(image["height"], image["width"], image["nChannels"], image["data"]):
        if h is None or h * w < 1024:
            out.append(None)
            continue
        px = np.frombuffer(data, dtype=np.uint8).reshape(h, w, c)
        out.append(dhash_pixels(px[..., :3] if c >= 3 else np.repeat(px[..., :1], 3, axis=2)))
    return pd.Series(out)
