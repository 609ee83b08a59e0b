import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmill import shared, versions
from siftmill.operators import dedup, graph, heavy_keys, references, snapshots, store

FILES = "id long, scan_id long, path string, size long, modified_at timestamp_ntz, hash_partial string, hash_full string, extra string"
SCANS = "id long, phase string, archive_root string, created_at timestamp_ntz, path string, size long"
T = dt.datetime


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---------------------------------------------------------------- heavy keys


def key_table(spark, data):
    return spark.createDataFrame(data, "size long, hash_partial string, hash_full string, n_rows long, key string")


def test_heavy_keys_with_nulls_ties_and_clashing_columns(spark):
    data = [(1, " AB ", "x", 9, "k")] * 50 + [(1, "ab", "y", 9, "k")] * 50 + [(2, "cd", None, 9, "k")] * 2 + [(None, "ef", "z", 9, "k"), (3, None, None, 9, None), (3, None, "q", 9, None)]
    got = rows(heavy_keys.candidate_key_results(key_table(spark, data), 0.5))
    assert got == sorted([(1, "ab", 100, 2, 100, True), (2, "cd", 2, 0, 4, False), (None, "ef", 1, 1, 0, False), (3, None, 2, 1, 6, False)], key=repr)
    assert rows(heavy_keys.heavy_candidate_keys(key_table(spark, data), 0.5)) == [(1, "ab")]


def test_heavy_keys_exact_threshold_and_many_keys(spark):
    data = [(i, "h", "f", 0, "") for i in range(980)] + [(5000, "t", "f", 0, "")] * 20
    assert rows(heavy_keys.heavy_candidate_keys(key_table(spark, data))) == [(5000, "t")]


def test_heavy_keys_empty(spark):
    assert rows(heavy_keys.candidate_key_results(key_table(spark, []))) == []


# ---------------------------------------------------------------- references


def tables(spark, files, groups, members, scans):
    return (
        spark.createDataFrame(files, FILES),
        spark.createDataFrame(groups, "id long, scan_id long, canonical_file_id long, refs long"),
        spark.createDataFrame(members, "group_id long, file_id long, confidence double, key long"),
        spark.createDataFrame(scans, SCANS),
    )


def test_orphans(spark):
    at = T(2020, 5, 4)
    t = tables(
        spark,
        [(1, 10, "a", 1, at, None, None, ""), (2, 99, "b", 1, None, None, None, ""), (2, 99, "b", 1, None, None, None, ""), (3, None, "c", 1, at, None, None, "")],
        [(1, 10, 77, 0), (2, 98, 78, 0), (3, 10, None, 0), (4, None, 1, 0)],
        [(1, 70, 1.0, 0), (1, 70, 0.5, 0), (9, 71, None, 0), (1, None, None, 0), (None, 72, None, 0), (1, 1, 1.0, 0)],
        [(10, "COMPLETE", "r", at, "", 0), (None, None, None, None, None, None)],
    )
    assert rows(references.orphan_records(*t)) == sorted(
        [
            ("files", 2, 99, "unknown"), ("duplicate_groups", 1, 77, "2020-05"), ("duplicate_groups", 2, 78, "unknown"),
            ("duplicate_members", 1, 70, "2020-05"), ("duplicate_members", 9, 71, "unknown"), ("duplicate_members", None, 72, "unknown"),
        ],
        key=repr,
    )
    assert rows(references.orphan_report(references.orphan_records(*t)).filter("table_name = 'files'")) == [("files", "unknown", 1, 1)]
    assert rows(references.orphan_records(*tables(spark, [], [], [], []))) == []


def test_ledger_follows_deltas(spark):
    files = spark.createDataFrame([(1, 10)], "id long, scan_id long")
    scans = spark.createDataFrame([(10,)], "id long")
    ledger = references.apply_deltas(None, references.references(files, "scan_id", "scans"))
    assert rows(references.orphan_keys(ledger)) == [("scans", 10, 1)]
    late = references.apply_deltas(ledger, references.existences(scans, "id", "scans"))
    assert rows(references.orphan_keys(late)) == []
    gone = references.apply_deltas(late, references.existences(scans, "id", "scans", -1))
    assert rows(references.orphan_keys(gone)) == [("scans", 10, 1)]
    assert rows(references.apply_deltas(gone, references.references(files, "scan_id", "scans", -1))) == []


def test_stored_ledger_serves_later_sessions(spark, tmp_path):
    files = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "id long, scan_id long")
    scans = spark.createDataFrame([(10,)], "id long")
    ledger = lambda: references.ReferenceLedger(spark.newSession(), str(tmp_path))
    assert ledger().counts() is None
    ledger().advance(references.references(files, "scan_id", "scans"))
    assert rows(references.orphan_keys(ledger().counts())) == [("scans", 10, 2), ("scans", 11, 1)]
    ledger().advance(references.existences(scans, "id", "scans"))  # arrives later
    assert rows(references.orphan_keys(ledger().counts())) == [("scans", 11, 1)]
    ledger().advance(references.references(files.filter("id = 3"), "scan_id", "scans", -1))
    assert rows(ledger().counts()) == [("scans", 10, 2, 1)]
    ledger().advance(references.existences(scans, "id", "scans", -1))
    assert rows(references.orphan_keys(ledger().counts())) == [("scans", 10, 2)] and len(list(tmp_path.iterdir())) == 1


def test_hot_keys_are_joined_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 5)
    many = spark.range(100).select((F.when(F.col("id") < 60, 0).otherwise(F.col("id"))).alias("k"), "id")
    one = many.groupBy("k").agg(F.count("*").alias("n"), F.lit("v").alias("v"))
    got = shared.join_by_key(many, one, "k", "n", 100)
    assert got.count() == 100 and got.filter("v = 'v'").count() == 100
    assert shared.join_by_key(many, one.filter("k = 0"), "k", "n", 100, "left_semi").count() == 60


# ---------------------------------------------------------------- snapshots


def test_changes(spark):
    d = lambda n: T(2020, 1, n)
    scans = [(1, "COMPLETE", "r", d(1), "", 0), (2, "FAILED", "r", d(2), "", 0), (3, "COMPLETE", "r", d(3), "", 0), (4, "COMPLETE", "r", d(4), "", 0), (5, "COMPLETE", "s", d(1), "", 0), (6, "COMPLETE", None, d(1), "", 0), (7, None, "r", None, "", 0)]
    files = [
        (1, 1, "a", 1, d(1), None, None, ""), (2, 1, "b", 1, None, None, None, ""), (3, 1, "c", 1, d(1).replace(microsecond=5), None, None, ""), (4, 1, None, 1, None, None, None, ""),
        (5, 2, "zz", 1, None, None, None, ""),
        (6, 3, "a", 2, d(1), None, None, ""), (7, 3, "a", 1, d(1), None, None, ""), (8, 3, "b", 1, d(1), None, None, ""), (9, 3, "c", 1, d(1), None, None, ""), (10, 3, "d", None, None, None, None, ""), (11, 3, "", 1, None, None, None, ""),
        (12, 5, "a", 1, None, None, None, ""),
    ]
    got = snapshots.path_changes(spark.createDataFrame(files, FILES), spark.createDataFrame(scans, SCANS))
    assert rows(got.select("scan_id", "path", "change_kind")) == sorted(
        [(3, "b", "changed"), (3, "d", "added"), (3, "", "added"), (4, "a", "removed"), (4, "b", "removed"), (4, "c", "removed"), (4, "d", "removed"), (4, "", "removed")], key=repr
    )
    full = snapshots.with_values(got, spark.createDataFrame(files, FILES)).filter("path = 'b' and scan_id = 3").first()
    assert full.old_modified_at is None and full.new_modified_at == d(1)


def test_changes_of_nothing(spark):
    assert rows(snapshots.path_changes(spark.createDataFrame([], FILES), spark.createDataFrame([], SCANS))) == []


def shot(spark, data, series="s"):
    rows = spark.createDataFrame([(series, 1, *r) for r in data], "series string, turn long, key string, id long, v long")
    return snapshots.key_entries(rows, "series", "turn", "key", "id", [F.col("v")]).drop("turn")


def came(spark, *turns):
    return spark.createDataFrame(list(turns), "series string, turn long")


def test_index_serves_later_sessions(spark, tmp_path):
    """Every step opens the folder anew, as a session of its own would."""
    index = lambda: snapshots.SnapshotIndex(spark.newSession(), str(tmp_path))
    assert rows(index().advance(shot(spark, [("a", 1, 1), ("b", 2, 1)]), came(spark, ("s", 1)), 1)) == []
    second = index()
    changed = second.advance(shot(spark, [("a", 3, 2), ("c", 4, 1)]), came(spark, ("s", 2)), 1)
    assert rows(changed.select("key", "change_kind", "row_id", "old_id")) == [("a", "changed", 3, 1), ("b", "removed", None, 2), ("c", "added", 4, None)]
    second.retire()
    assert [p.name for p in tmp_path.iterdir()] == ["v00000001"]
    assert rows(index().advance(shot(spark, [("x", 9, 9)], "t"), came(spark, ("t", 1)), 1)) == []  # s stays as it was
    assert rows(index().advance(shot(spark, [("a", 5, 2), ("c", 6, 1)]), came(spark, ("s", 3)), 1)) == []
    gone = index().advance(shot(spark, []), came(spark, ("s", 4), ("t", 2)), 2)
    assert rows(gone.select("series", "key", "change_kind")) == [("s", "a", "removed"), ("s", "c", "removed"), ("t", "x", "removed")]


def test_a_version_without_its_note_is_not_current(spark, tmp_path):
    t = versions.VersionedTable(spark, str(tmp_path), ["k"])
    assert t.version() == -1 and t.read() is None
    assert t.write(spark.range(5).withColumnRenamed("id", "k"), 8, label="x") == 0 and t.note(0)["label"] == "x" and t.note(0)["rows"] == 5
    spark.range(9).withColumnRenamed("id", "k").write.parquet(f"{tmp_path}/v00000001")  # a writer lost half-way
    assert t.version() == 0 and t.read().count() == 5
    assert t.write(spark.range(7).withColumnRenamed("id", "k"), 8) == 2 and versions.VersionedTable(spark, str(tmp_path), ["k"]).read().count() == 7
    t.retire()
    assert [p.name for p in tmp_path.iterdir()] == ["v00000002"]


def test_buckets_follow_the_rows():
    assert [versions.buckets_for(n) for n in (0, 1, 10**6, 9 * 10**6, 10**8, 10**12)] == [8, 8, 8, 16, 128, 65536]


def test_an_index_that_outgrew_its_buckets_gets_more(spark, tmp_path, monkeypatch):
    index = snapshots.SnapshotIndex(spark, str(tmp_path))
    index.advance(shot(spark, [(str(i), i, i) for i in range(100)]), came(spark, ("s", 1)), 1)
    monkeypatch.setattr(versions, "ROWS_PER_BUCKET", 5)
    got = index.advance(shot(spark, [(str(i), i, i) for i in range(1, 101)]), came(spark, ("s", 2)), 1)
    assert index.table.note(1)["buckets"] == 32 and rows(got.select("key", "change_kind")) == [("0", "removed"), ("100", "added")]


def test_probes_do_not_shuffle(spark, tmp_path):
    index, data = snapshots.SnapshotIndex(spark, str(tmp_path)), [(str(i), i, i) for i in range(50)]
    index.advance(shot(spark, data), came(spark, ("s", 1)), 1)
    staged = versions.VersionedTable(spark, f"{tmp_path}/staged", snapshots.KEY)
    staged.write(shot(spark, data), 8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = staged.read().join(index.table.read(), snapshots.KEY, "full_outer")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Exchange" not in plan


# ---------------------------------------------------------------- groups, components, store


def test_exact_groups_keep_the_oldest(spark):
    data = [(1, 1, "/b", 5, T(2020, 1, 1), "p", "H", ""), (2, 1, "/a", 5, T(2000, 1, 1), "p", " h", ""), (3, 1, "/c", 5, None, "p", "h", ""), (4, 1, "/d", 0, None, "p", "h", ""), (5, 2, "/e", 5, None, None, None, "")]
    df = spark.createDataFrame(data, FILES)
    assert rows(dedup.exact_groups(df)) == [(1, 5, "h", 3, 2, "/a", 10)]
    assert rows(dedup.exact_links(df)) == [(1, 1, 2), (2, 1, 2), (3, 1, 2)]
    assert rows(dedup.candidate_groups(df)) == [(1, 5, "p", 3, 1)]
    assert rows(dedup.exact_groups(spark.createDataFrame([], FILES))) == []


def near_records(spark, data):
    return spark.createDataFrame(data, "id long, kind string, size long, sig array<long>")


def test_members_give_every_linked_document(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 3)
    one, near, far = list(range(128)), list(range(100)) + [9000] * 28, [7000 + i for i in range(128)]
    data = [(i, "k", 10, one) for i in range(1, 9)] + [(i, "k", 11, near) for i in (20, 21, 22)] + [(30, "k", 10, far), (31, "m", 10, one), (32, None, 10, one), (33, "k", 10, None)]
    members = dedup.near_duplicate_members(near_records(spark, data))
    assert rows(members) == sorted([(i, 1, 8) for i in range(1, 9)] + [(i, 20, 3) for i in (20, 21, 22)] + [(30, 30, 1), (31, 31, 1)], key=repr)
    side = lambda s: members.select(F.col("id").alias(s), F.col("class_id").alias(f"id_{s}"))
    links = dedup.near_duplicate_classes(near_records(spark, data)).join(side("a"), "id_a").join(side("b"), "id_b")
    assert rows(links.select("a", "b")) == sorted([(a, b) for a in range(1, 9) for b in (20, 21, 22)], key=repr)


def test_pairs_with_one_match_in_each_band(spark):
    r, data = random.Random(5), []
    for i in range(40):
        one = [10_000 * i + k for k in range(128)]
        two = list(one)
        for k in range(64):
            two[2 * k + r.randrange(2)] += 500
        data += [(2 * i, "k", 10, one), (2 * i + 1, "k", 10, two)]
    assert rows(dedup.near_duplicate_classes(near_records(spark, data)).select("id_a", "id_b", "similarity")) == sorted([(2 * i, 2 * i + 1, 0.5) for i in range(40)], key=repr)
    with pytest.raises(ValueError):
        dedup.near_duplicate_classes(near_records(spark, data), 0.49)


def test_sketches_never_drop_a_pair(spark):
    r = random.Random(3)
    sig = lambda: [r.randrange(2**32) for _ in range(128)]
    pairs = []
    for same in (0, 63, 64, 65, 100, 127, 128) * 5:
        a, b = sig(), sig()
        for k in r.sample(range(128), same):
            b[k] = a[k]
        pairs.append((same, a, b))
    df = spark.createDataFrame(pairs, "same int, a array<long>, b array<long>")
    got = df.select("same", dedup.least_differing(dedup.sketch(F.col("a")), dedup.sketch(F.col("b"))).alias("d")).collect()
    assert all(x.d <= 128 - x.same for x in got) and all(x.d > 80 for x in got if x.same == 0)


@pytest.mark.parametrize("one_task", [0, 1_000_000])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK_EDGES", one_task)
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3), (3, None), (2, 1)] + [(200, 200 + i) for i in range(1, 60)], "a long, b long")
    got = {r.v: r.root for r in graph.components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in (100, 101, 102)}, **{200 + i: 200 for i in range(60)}}
    assert rows(graph.components(links.limit(0))) == []
    monkeypatch.setattr(graph, "MAX_ROUNDS", 0)
    with pytest.raises(RuntimeError):
        graph.components(links)


def test_one_task_contraction_against_union_find():
    r = np.random.default_rng(8)
    for n, m in ((2, 1), (50, 40), (4000, 3000), (4000, 9000)):
        a, b = r.integers(0, n, m), r.integers(0, n, m)
        a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        up = list(range(n))

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for x, y in zip(a.tolist(), b.tolist()):
            x, y = sorted((root(x), root(y)))
            up[y] = x
        got = dict(zip(*(x.tolist() for x in graph.hang_on_smallest(a, b)[::-1])))
        assert got == {x: root(x) for x in {*a.tolist(), *b.tolist()} if root(x) != x}


def cluster_inputs(spark, sizes, pairs):
    files = spark.createDataFrame([(i, f"/{i}", s, None, "text/html") for i, s in sizes.items()], "id long, path string, size long, modified_at timestamp_ntz, mime_type string")
    return spark.createDataFrame([(a, b, x, "s") for a, b, x in pairs], "file_id_a long, file_id_b long, similarity double, strategy string"), files


def test_clusters_are_pruned_by_size(spark):
    pairs, files = cluster_inputs(spark, {1: 200, 2: 101, 3: 399, 4: 90, 5: 200}, [(1, 2, 0.9), (2, 3, 0.8), (3, 4, 0.7), (1, 5, 0.97), (5, 5, 0.9), (1, None, 0.9), (1, 9, float("nan"))])
    # 4 is below half of 1; of 101 (|ln| .683) and 399 (.691) the farther one goes
    assert rows(dedup.near_duplicate_clusters(pairs, files)) == [(1, "near-dup-document", 1, 3, 0.9, "review")]


def test_cluster_cap(spark):
    sizes = {i: 100 for i in range(1, 202)}
    hub = [(1, i, 0.96) for i in range(2, 102)]
    pairs, files = cluster_inputs(spark, sizes, hub + [(102, i, 0.96) for i in range(103, 202)])
    assert rows(dedup.near_duplicate_clusters(pairs, files)) == [(102, "near-dup-document", 102, 100, 0.96, "auto")]


def test_large_clusters_get_their_own_queue(spark):
    pairs, files = cluster_inputs(spark, {i: 100 for i in range(1, 202)}, [(1, i, 0.96) for i in range(2, 102)] + [(102, i, 0.96) for i in range(103, 202)])
    want = [(1, "near-dup-document", 1, 101, 0.96, "oversize"), (102, "near-dup-document", 102, 100, 0.96, "auto")]
    assert rows(dedup.near_duplicate_clusters(pairs, files, oversize=True)) == want
    assert rows(dedup.near_duplicate_clusters(pairs, files, max_members=101)) == [(*want[0][:5], "auto"), want[1]]


def test_reuse(spark):
    at = T(2020, 1, 1, 1, 1, 1, 500)
    old = spark.createDataFrame([(1, 1, "a", 5, at, "p", "f", ""), (2, 1, "a", 6, at, "q", "g", ""), (3, 1, "b", 5, at, None, "f", ""), (4, 1, "c", 5, None, "p", "f", "")], FILES)
    new = spark.createDataFrame([(11, 2, "a", 6, at.replace(microsecond=0), None, None, ""), (12, 2, "b", 5, at, None, None, ""), (13, 2, "c", 5, None, None, None, ""), (14, 2, "d", 5, at, None, None, "")], FILES)
    assert rows(store.reuse_fingerprints(new, old)) == [(11, "a", True, "q", "g"), (12, "b", False, None, None), (13, "c", False, None, None), (14, "d", False, None, None)]


@pytest.mark.parametrize("block,hot_rows", [(1000, 20_000), (3, 5)])
def test_image_links_against_all_pairs(spark, monkeypatch, block, hot_rows):
    monkeypatch.setattr(dedup, "BLOCK", block)
    monkeypatch.setattr(shared, "HOT_ROWS", hot_rows)
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(12)]
    images = [(0, "image/png", bytes(8)), (1, "image/png", bytes(8)), (2, None, bytes(8)), (3, "image/png", None), (4, "image/png", b"short")]
    for i in range(90):
        x = base[i % 12]
        for bit in r.sample(range(64), r.randrange(0, 9)):
            x ^= 1 << bit
        images.append((10 + i, r.choice(["image/png", "image/png", "image/gif"]), x.to_bytes(8, "big")))
    links = dedup.image_links(spark.createDataFrame([(*x, "x") for x in images], "id long, kind string, fp binary, n string"))
    classes = {}
    for i, kind, f in images:
        if kind and f and len(f) == 8:
            classes.setdefault((kind, int.from_bytes(f, "big")), []).append(i)
    want = set()
    for (ka, x), a in classes.items():
        for (kb, y), b in classes.items():
            d = (x ^ y).bit_count()
            if ka == kb and min(a) < min(b) and 0 < d <= 6:
                want.add((min(a), min(b), 1 - d / 64, len(a), len(b)))
    assert {tuple(x) for x in links.collect()} == want and len(want) > 20
    with pytest.raises(ValueError):
        dedup.image_links(links, 0.5)


def test_strategies_are_clustered_apart(spark):
    at = T(2020, 1, 1)
    files = spark.createDataFrame([(i, 1, f"/p{i}", 10 if i < 5 else 1000 * i, at, None, None, "") for i in range(1, 10)], FILES).withColumn("mime_type", F.lit("text/html"))
    pairs = [(1, 2, 1.0, "exact-hash"), (2, 9, 1.0, " Exact-Hash"), (1, 3, 0.96, "near-dup-document"), (3, 4, 0.97, "near-dup-document"), (5, 6, 0.9, None), (7, 99, 0.9, None), (None, 1, 1.0, "exact-hash"), (4, 1, float("nan"), "near-dup-document")]
    groups, members = dedup.clusters_by_strategy(spark.createDataFrame(pairs, "file_id_a long, file_id_b long, similarity double, strategy string"), files)
    assert rows(groups) == [("exact-hash", 1, 1, 3, 1.0), ("near-dup-document", 1, 1, 3, 0.96), ("unknown", 5, 5, 2, 0.9)]
    assert {tuple(r) for r in members.collect()} == {("exact-hash", 1, i) for i in (1, 2, 9)} | {("near-dup-document", 1, i) for i in (1, 3, 4)} | {("unknown", 5, 5), ("unknown", 5, 6)}


def test_heavy_keys_of_small_shares(spark):
    data = spark.range(20_000).select(F.when(F.col("id") < 30, F.lit(7)).otherwise(F.col("id") + 100).alias("k"), F.lit("v").alias("v"), F.lit(1).alias("s"))
    got = heavy_keys.per_key_results(data, ["k"], "v", "s", share=1 / 1000).filter("is_heavy").collect()
    assert [(r.k, r.n_rows) for r in got] == [(7, 30)]
    with pytest.raises(ValueError):
        heavy_keys.per_key_results(data, ["k"], "v", "s", share=1e-9)


def test_first_of_each_group_by_salted_parts(spark):
    groups = spark.createDataFrame([(i, i % 3, "s", None if i % 10 == 0 else i / 100, 1) for i in range(90)], "id long, scan_id long, strategy string, confidence double, canonical_file_id long")
    got = [(r.scan_id, r.id) for r in dedup_order(store.least_certain(groups, 4))]
    want = []
    for scan in range(3):
        ids = sorted((i for i in range(90) if i % 3 == scan), key=lambda i: (i % 10 != 0, i / 100, i))
        want += [(scan, i) for i in ids[:4]]
    assert got == want


def dedup_order(df):
    return df.orderBy("scan_id", "place").collect()


def test_exclusion_by_components(spark, monkeypatch):
    files = spark.createDataFrame([(1, "/a/arch/x"), (2, "/a/arch2/x"), (3, "/a/arch"), (4, None), (5, "/r")], "id long, path string")
    roots = spark.createDataFrame([("/a/arch/",), (None,)], "root string")
    for few in (5000, 0):  # literals, then a join
        monkeypatch.setattr(store, "FEW_ROOTS", few)
        assert [r.id for r in store.exclude_under(files, roots).orderBy("id").collect()] == [2, 4, 5]


# ---------------------------------------------------------------- shared folder


def test_shared_tables(spark):
    assert spark.sparkContext.getConf().get("spark.checkpoint.dir", "") in shared.shared_dir(spark)
    t = shared.cut(spark.range(7), "t", {"s": F.col("id")})
    assert (t.rows, t.sums, t.df.count()) == (7, {"s": 21}, 7)
    assert shared.cut(spark.range(0), "t", {"s": F.col("id")}).sums == {"s": 0}
    t.drop()
    assert shared.hot_limit(10**9) == 10**6
