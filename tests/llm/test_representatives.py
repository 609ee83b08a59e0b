import datetime as dt
import random

from siftmill.llm import representatives as r

T = dt.datetime


def test_progressive_alignment():
    values = ["/data/2019/photos/a.jpg", "/data/2019/photos/old/a.jpg", "/data/2018/photos/a.jpg", "/data/2019/fotos/a.jpg"]
    assert r.consensus_value([(v, 1.0) for v in values]) == values[0]
    assert r.consensus_value([]) is None and r.consensus_value([("", 1.0), ("", 1.0), ("a", 0.1)]) in ("", "a")
    assert r.consensus_value([("b", 1.0), ("a", 1.0)]) == "a"
    columns = r.align([(r.tokenize("a b c"), 2.0), (r.tokenize("a c"), 1.0)])
    assert r.elect(columns) == r.tokenize("a b c")
    assert all(abs(sum(c.values()) - 3.0) < 1e-9 for c in columns)


def test_edits():
    assert r.edits(list("kitten"), list("sitting")) == 3 and r.edits([], list("ab")) == 2 and r.edits(["x"], ["x"]) == 0


def noisy(seed, n):
    rnd, out = random.Random(seed), []
    for i in range(n):
        p = ["data", "lib", "photos", "scan", "7"]
        if rnd.random() < 0.3:
            p[rnd.randrange(5)] = rnd.choice("abcdef") + str(i)
        if rnd.random() < 0.2:
            p.insert(rnd.randrange(5), "x" + str(rnd.randrange(9)))
        out.append("/" + "/".join(p))
    return out


def test_large_groups_agree_with_small(spark):
    rows = [(k, v, 1.0) for k in range(2) for v in noisy(k, 300)] + [(5, "/only", 1.0), (6, None, 1.0)]
    df = spark.createDataFrame(rows, "key long, value string, w double")
    want = {0: "/data/lib/photos/scan/7", 1: "/data/lib/photos/scan/7", 5: "/only"}
    assert {x.key: x.value for x in r.token_consensus(df, 10_000).collect()} == want
    assert {x.key: x.value for x in r.token_consensus(df, 16).collect()} == want


FILES = "id long, path string, provider string, size long, modified_at timestamp_ntz, mime_type string, hash_partial string, hash_full string, copy_hint string, group_id long, w double"


def store(spark, files, members, groups=((1, 1),), scans=((1, T(2020, 1, 1)),)):
    return (
        spark.createDataFrame(list(groups), "id long, scan_id long"),
        spark.createDataFrame(members, "group_id long, file_id long"),
        spark.createDataFrame(files, FILES),
        spark.createDataFrame(list(scans), "id long, created_at timestamp_ntz"),
        spark.createDataFrame([("local", 1), ("nas", 2), (None, 3)], "provider string, trust_rank long"),
    )


def f(i, path="/p", provider="local", at=None, size=1, **kw):
    return (i, path, provider, size, at, kw.get("mime"), kw.get("part"), kw.get("full"), None, 0, 0.0)


def survivors(spark, files, **kw):
    members = kw.pop("members", [(1, x[0]) for x in files])
    return [(x.group_id, x.file_id) for x in r.best_representatives(*store(spark, files, members, **kw)).select("group_id", "file_id").collect()]


def test_order_of_survivors(spark):
    assert survivors(spark, [f(1, at=T(2019, 1, 1)), f(2, at=T(2018, 1, 1)), f(3, at=T(1980, 1, 1)), f(4, at=T(2021, 1, 1))]) == [(1, 2)]
    assert survivors(spark, [f(1, provider="nas"), f(2, provider=" LOCAL "), f(3, provider=None), f(4, provider="odd")]) == [(1, 2)]
    assert survivors(spark, [f(3, "/äö"), f(2, "/abc"), f(4, None)]) == [(1, 3)]
    assert survivors(spark, [f(3), f(2)]) == [(1, 2)]
    assert survivors(spark, [f(1, at=T(1990, 1, 1)), f(2, at=T(2020, 1, 1))], scans=[(9, T(2000, 1, 1))]) == [(1, 1)]


def test_members_that_count(spark):
    two = [f(1), f(2)]
    assert survivors(spark, two, members=[(1, 1), (1, 1), (1, 99), (None, 2), (1, None)]) == []
    assert survivors(spark, two, members=[(1, 1), (1, 2), (7, 1), (7, 2)]) == [(1, 1)]
    assert survivors(spark, two + two) == [(1, 1)]
    assert survivors(spark, []) == []


def test_fields_are_filled_from_all_members(spark):
    files = [f(1, "/a/x/1.txt", size=5, at=T(2000, 1, 1)), f(2, "/a/x/1.txt", size=6, mime="Text/Plain;q=1", part=" AB "), f(3, "/a/y/1.txt", size=6, mime="text/plain")]
    got = r.best_representatives(*store(spark, files, [(1, 1), (1, 2), (1, 3)])).first()
    assert (got.file_id, got.members, got.path, got.size, got.mime_type, got.hash_partial, got.hash_full) == (1, 3, "/a/x/1.txt", 6, "text/plain", "ab", None)
    assert got.modified_at == T(2000, 1, 1)
