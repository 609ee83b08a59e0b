import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmill.llm import near_dup
from siftmill import shared
from siftmill.llm.near_dup import choose_levels, latest_signatures, near_duplicate_pairs, near_duplicate_links

SCHEMA = "id long, grp string, sig binary, key string, n long"


def sig(values):
    return np.asarray(values, dtype=">u8").tobytes()


def brute(rows, low=96):
    rows = [(i, g, np.frombuffer(s, ">u8")) for i, g, s, *_ in rows if i is not None and g is not None and s is not None and len(s) == 1024]
    out = set()
    for x, (i, g, a) in enumerate(rows):
        for j, h, b in rows[x + 1 :]:
            if g == h and i != j and low <= int((a == b).sum()) < 128:
                out.add((min(i, j), max(i, j)))
    return out


def found(spark, rows, **kw):
    df = near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA), **kw).select("file_id_a", "file_id_b")
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got)) or any(r[0] is None for r in rows)
    return set(got)


@pytest.mark.parametrize("seed,blocks", [(1, None), (2, 3)])
def test_against_all_pairs(spark, monkeypatch, seed, blocks):
    """Families around the threshold, shared boilerplate, copies; also with tiny blocks."""
    if blocks:
        monkeypatch.setattr(near_dup, "BLOCK", blocks)
    r = np.random.default_rng(seed)
    plate = r.integers(0, 2**63, 128)
    rows = []
    for family in range(12):
        base = r.integers(0, 2**63, 128)
        base[:40] = plate[:40]
        for k in range(8):
            v = base.copy()
            change = r.choice(128, int(r.integers(0, 45)), replace=False)
            v[change] = r.integers(0, 2**63, len(change))
            rows.append((len(rows), "x" if family % 3 else "y", sig(v), "k", 0))
    rows += [(1000 + i, rows[0][1], rows[0][2], "k", 0) for i in range(5)]
    want = brute(rows)
    assert want and found(spark, rows) == want
    assert found(spark, rows, max_level=1) == want


def test_edge_cases(spark):
    a = np.arange(128)
    b, c = a.copy(), a.copy()
    b[:32], c[:33] = 999, 999
    rows = [
        (1, "g", sig(a), None, None), (2, "g", sig(b), None, None), (3, "g", sig(c), None, None), (4, "h", sig(a), None, None),
        (5, "g", sig(a)[:512], None, None), (6, "g", None, None, None), (7, None, sig(a), None, None), (None, "g", sig(a), None, None),
        (2, "g", sig(b), None, None), (8, "g", b"", None, None),
    ]
    assert found(spark, rows) == {(1, 2), (2, 3)}
    assert found(spark, []) == set()


def test_hot_class_is_salted(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "hot_limit", lambda rows: 10)
    a = np.arange(128)
    b = a.copy()
    b[0] = 999
    rows = [(i, "g", sig(a), None, None) for i in range(50)] + [(100 + i, "g", sig(b), None, None) for i in range(3)]
    assert found(spark, rows) == {(i, 100 + j) for i in range(50) for j in range(3)}


def test_levels_follow_cost():
    free = np.zeros((1, 128))
    crowded = np.concatenate([np.zeros(32), [40.0], np.full(95, 41.0)])[None, :]
    assert choose_levels(free, 32, 8, 12.0)[0] == 1
    assert choose_levels(crowded, 32, 8, 100.0)[0] >= 1
    steady = np.concatenate([np.full(33, 5.0), np.zeros(95)])[None, :]
    assert choose_levels(steady, 32, 8, 12.0)[0] > 1  # a longer prefix costs little and spares verification


def test_latest_scan_only(spark):
    scans = spark.createDataFrame([(1, "COMPLETE", "r", 1), (2, "COMPLETE", "r", 2), (3, "FAILED", "r", 3), (4, "COMPLETE", None, 9)], "id long, phase string, archive_root string, created_at long")
    files = spark.createDataFrame([(i, i, " Text/HTML ;x=1", b"s") for i in range(1, 5)] + [(9, 2, None, b"s"), (10, 2, "a", None)], "id long, scan_id long, mime_type string, minhash_signature binary")
    assert [tuple(r)[:2] for r in latest_signatures(files, scans).collect()] == [(2, "text/html")]


def test_one_group_of_copies_may_hold_a_third(spark):
    r = np.random.default_rng(5)
    rows = [(i, "g", sig(np.arange(128)), None, None) for i in range(300)] + [(1000 + i, "g", sig(r.integers(0, 2**63, 128)), None, None) for i in range(600)]
    assert found(spark, rows) == set()
    assert near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA)).filter(F.col("agree") > 0).count() == 0


@pytest.mark.parametrize("hot_rows", [5, 20_000])
def test_a_record_with_many_neighbours(spark, monkeypatch, hot_rows):
    """One record near a third of all others, one token shared by all; links and members say what the pairs say."""
    monkeypatch.setattr(shared, "HOT_ROWS", hot_rows)
    r = np.random.default_rng(6)
    hub = np.arange(128)
    near = []
    for _ in range(40):
        x = r.integers(10**6, 2**62, 128)
        at = r.permutation(127)[:97] + 1
        x[at], x[0] = hub[at], 0
        near.append(x)
    far = [np.concatenate([[0], r.integers(10**6, 2**62, 127)]) for _ in range(80)]
    rows = [(1, "g", sig(hub), None, None), (500, "g", sig(hub), None, None)] + [(10 + i, "g", sig(x), None, None) for i, x in enumerate(near + far)]
    want = {(min(a, b), max(a, b)) for a in (1, 500) for b in range(10, 50)}
    agree = lambda x, y: int((x == y).sum())
    want |= {(10 + i, 10 + j) for i in range(40) for j in range(i + 1, 40) if agree(near[i], near[j]) >= 96}
    assert found(spark, rows) == want
    links, members = near_duplicate_links(spark.createDataFrame(rows, SCHEMA))
    of = {x.id: x.class_id for x in members.collect()}
    got = [tuple(x) for x in links.collect()]
    assert of[500] == 1 and len(of) == len(rows) and len(got) == len({x[:2] for x in got})
    assert {(a, b) for a, b, *_ in got} == {(min(of[a], of[b]), max(of[a], of[b])) for a, b in want}
    assert all(n == (2 if a == 1 else 1) for a, _, _, n, _ in got)
