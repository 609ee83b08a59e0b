import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmill.functions import columns as c
from siftmill.functions import fingerprints as fp


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "name,hint",
    [("report (1).pdf", True), ("Copy of report.pdf", True), ("report - Copy.pdf", True), ("budget - Copy (2).xlsx", True), ("report.pdf", False), ("photo_001.jpg", False), (None, False), ("  ", False)],
)
def test_copy_hint(spark, name, hint):
    assert one(spark, name, c.copy_hint) == ("explicit_copy" if hint else None)


@pytest.mark.parametrize("text,want", [("hello", ["hello"]), ("one two three", ["one two", "two three"]), ("HELLO World", ["hello world"]), ("hello, world!", ["hello world"]), ("", []), ("   ", []), (None, []), ("日本語", [""])])
def test_shingles(spark, text, want):
    assert one(spark, text, c.shingles) == want


@pytest.mark.parametrize("n,want", [(0, "0 B"), (1023, "1023 B"), (1280, "1.3 KB"), (1024**2, "1.0 MB"), (5 * 1024**3 // 2, "2.50 GB"), (None, None)])
def test_format_bytes(spark, n, want):
    assert one(spark, n, c.format_bytes, "long") == want


@pytest.mark.parametrize("p,want", [("/a/b", "/a/b"), ("/a/b/c/d.txt", "…/c/d.txt"), ("C:\\x\\y\\z\\q", "…/z/q"), (None, "")])
def test_short_path(spark, p, want):
    assert one(spark, p, c.short_path) == want


@pytest.mark.parametrize("p,want", [("/home/u/r.pdf", "/mnt/b/run_5/home/u/r.pdf"), ("C:\\U\\r.pdf", "/mnt/b/run_5/C/U/r.pdf")])
def test_archive_path(spark, p, want):
    assert one(spark, p, lambda x: c.archive_path(F.lit("/mnt/b"), F.lit(5), x)) == want


@pytest.mark.parametrize("n,plain,padded", [(5, "5s", "5s"), (65, "1m 5s", "1m 05s"), (3725, "1h 2m 5s", "1h 02m 05s")])
def test_duration(spark, n, plain, padded):
    assert one(spark, n, c.duration, "long") == plain
    assert one(spark, n, lambda x: c.duration(x, True), "long") == padded


def test_path_components(spark):
    assert not one(spark, "/a/arch2/x", lambda x: c.is_under(x, "/a/arch"))
    assert one(spark, "/a/arch/x", lambda x: c.is_under(x, "/a/arch/"))
    assert one(spark, "/a/b", c.ancestors) == ["", "/a", "/a/b"]


def test_coefficients():
    a, b = fp.coefficients()
    assert list(a[:4]) == [284299928, 742161581, 1186191754, 1169538162]
    assert list(b[:4]) == [581331608, 195931685, 1839119971, 1128347109]
    assert (int(a.sum()), int(b.sum())) == (128344730944, 138001144563)


def test_hashes(spark):
    data = random.Random(1).randbytes(5000)
    df = spark.createDataFrame([(data,), (b"",), (None,)], "x binary").select(fp.partial_hash(F.col("x")), fp.full_hash(F.col("x"))).collect()
    assert df[0][0] == hashlib.sha256(data[:4096]).hexdigest() and df[0][1] == hashlib.sha256(data).hexdigest()
    assert df[1][0] == df[1][1] == hashlib.sha256(b"").hexdigest() and df[2][0] is None
    assert one(spark, "quick brown", fp.shingle_hash) == 3004814659


def test_minhash(spark):
    rows = [(1, " ".join(f"s{i}" for i in range(10))), (2, " ".join(f"s{i}" for i in [*range(9), 99])), (3, ""), (4, None), (5, "日本語"), (6, "x " * 200_000)]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "i int, t string").select("i", fp.signature(F.col("t"))).collect()}
    assert got[3] == got[4] == [fp.NOTHING] * 128
    assert got[5] == list(fp.coefficients()[1] % fp.MODULUS)
    assert sum(x == y for x, y in zip(got[1], got[2])) > 64
    assert len(got[6]) == 128 and max(got[6]) < fp.MODULUS


def test_image_hash():
    y, x = np.mgrid[0:64, 0:64]
    flat = np.repeat((x * 3)[..., None], 3, axis=2).astype(np.uint8)
    near = np.clip(flat.astype(int) + 10, 0, 255).astype(np.uint8)
    bits = lambda h: int.from_bytes(h, "big")
    same = lambda a, b: 1 - (bits(fp.dhash_pixels(a)) ^ bits(fp.dhash_pixels(b))).bit_count() / 64
    assert same(flat, 255 - flat) < 0.3 and same(flat, near) > 0.7


def test_dhash_similarity(spark):
    rows = [(b"\xff" * 8, b"\xff" * 8), (b"\xff" * 8, b"\x00" * 8), (b"", b""), (b"\x01" * 8, b"\x01" * 7), (None, b"\x01" * 8)]
    got = [r[0] for r in spark.createDataFrame(rows, "a binary, b binary").select(fp.dhash_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_markup(spark):
    assert one(spark, "<p>a&amp;b</p><script>x<y</script> 1 < 2", c.strip_markup) == "a&b 1 < 2"
