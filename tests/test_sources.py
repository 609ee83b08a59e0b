import datetime as dt
import hashlib
import json
import os
import zlib

import pytest
from pyspark.sql import functions as F

from siftmill import pipeline
from siftmill.operators import actions, store
from siftmill.sources.files import fingerprint_images, hash_files, list_files
from siftmill.sources.provider import ProviderSource
from siftmill.streaming.rescan import LatestFiles, follow_listings


def write(folder, **files):
    for name, data in files.items():
        p = folder / name.replace("__", "/").replace("_dot_", ".")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)


def test_listing_and_groups(spark, tmp_path):
    write(tmp_path, a_dot_txt=b"same", sub__b_dot_txt=b"same", c_dot_pdf=b"other", empty=b"", arch__d_dot_txt=b"same", arch2__e_dot_txt=b"same")
    got = list_files(spark, [str(tmp_path), str(tmp_path / "missing")], [str(tmp_path / "arch")])
    assert sorted(os.path.relpath(r.path, tmp_path) for r in got.collect()) == ["a.txt", "arch2/e.txt", "c.pdf", "sub/b.txt"]
    groups = pipeline.duplicates(spark, [str(tmp_path)]).collect()
    assert [(g.n_files, g.reclaimable_bytes) for g in groups] == [(4, 12)]
    assert list_files(spark, [str(tmp_path / "missing")]).count() == 0


def test_shared_prefix_is_no_duplicate(spark, tmp_path):
    head = os.urandom(4096)
    write(tmp_path, a=head + b"AAAA", b=head + b"BBBB")
    assert pipeline.duplicates(spark, [str(tmp_path)]).count() == 0
    h = hash_files(list_files(spark, [str(tmp_path)]), whole=True).collect()
    assert h[0].hash_partial == h[1].hash_partial and h[0].hash_full != h[1].hash_full


def test_provider(spark, tmp_path):
    write(tmp_path, x=b"12", d__y=b"345")
    spark.dataSource.register(ProviderSource)
    df = spark.read.format("siftmill_provider").option("roots", json.dumps([str(tmp_path), "/no/such/root"])).load()
    assert sorted((os.path.basename(r.path), r.size, r.provider) for r in df.collect()) == [("x", 2, "local"), ("y", 3, "local")]


def png(pixels):
    chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    h, w = len(pixels), len(pixels[0])
    raw = b"".join(b"\0" + bytes(v for x in row for v in (x, x, x)) for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", w.to_bytes(4, "big") + h.to_bytes(4, "big") + b"\x08\x02\0\0\0") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    write(tmp_path, up_dot_png=png([[x * 3 for x in range(64)]] * 64), down_dot_png=png([[255 - x * 3 for x in range(64)]] * 64), tiny_dot_png=png([[0] * 8] * 8), bad_dot_png=b"no image")
    got = {os.path.basename(r.path): r.fingerprint for r in fingerprint_images(spark, [str(tmp_path)]).collect()}
    assert bytes(got["up.png"]) == b"\0" * 8 and bytes(got["down.png"]) == b"\xff" * 8 and got["tiny.png"] is None and "bad.png" not in got


def archive(spark, tmp_path, *names):
    """Files of one group in a folder, the first kept, and the plan that archives the others."""
    src, root = tmp_path / "in", tmp_path / "archive"
    files = spark.createDataFrame([(i + 1, str(src / n), 1, None, "x") for i, n in enumerate(names)], "id long, path string, size long, modified_at timestamp_ntz, mime_type string")
    scans = spark.createDataFrame([(7, str(root))], "id long, archive_root string")
    groups = spark.createDataFrame([(1, 7, 1, "exact-hash", 1.0), (2, 7, 1, "exact-hash", 1.0)], "id long, scan_id long, canonical_file_id long, strategy string, confidence double")
    members = spark.createDataFrame([(g, i + 1) for g in (1, 2) for i in range(len(names))], "group_id long, file_id long")
    return src, root, store.archive_plan(scans, files, groups, members)


def test_stage_restore_purge(spark, tmp_path):
    src, root, plan = archive(spark, tmp_path, "a", "b", "gone")
    write(src, a=b"1", b=b"1")
    log = actions.ActionLog(str(tmp_path / "log" / "moves.jsonl"))
    assert actions.stage(plan, log) == (1, 0) and not (src / "b").exists()
    assert os.path.exists(f"{root}/run_7{src}/b")
    taken = log.actions(spark)
    assert [(r.id, r.action_type, r.file_id, r.original_path, r.undone) for r in taken.collect()] == [(1, "MOVE", 2, str(src / "b"), False)]
    assert actions.restore(store.movable_back(taken)) == 1 and (src / "b").read_bytes() == b"1"
    assert not actions.purge(str(root), 7) and actions.purge(str(root), 7, confirmed=True)
    assert actions.free_bytes(str(tmp_path / "x" / "y")) > 0


def test_nothing_is_written_over(spark, tmp_path):
    src, root, plan = archive(spark, tmp_path, "a", "b")
    write(src, a=b"1", b=b"mine")
    there = root / f"run_7{src}" / "b"
    there.parent.mkdir(parents=True)
    there.write_bytes(b"theirs")
    log = actions.ActionLog(str(tmp_path / "moves.jsonl"))
    assert actions.stage(plan, log) == (0, 1)
    assert there.read_bytes() == b"theirs" and (src / "b").read_bytes() == b"mine" and log.actions(spark).count() == 0
    with pytest.raises(FileExistsError):
        actions.move_new(str(src / "b"), str(there))


def test_a_crash_between_moves_leaves_the_way_back(spark, tmp_path, monkeypatch):
    src, root, plan = archive(spark, tmp_path, "a", "b", "c", "d")
    write(src, a=b"1", b=b"2", c=b"3", d=b"4")
    log, real = actions.ActionLog(str(tmp_path / "moves.jsonl")), actions.move_new

    def dies(source, destination):
        real(source, destination)
        if source.endswith("c"):
            raise KeyboardInterrupt  # after the move, before its line in the log

    monkeypatch.setattr(actions, "move_new", dies)
    with pytest.raises(KeyboardInterrupt):
        actions.stage(plan, log)
    monkeypatch.setattr(actions, "move_new", real)
    again = actions.ActionLog(log.path)
    assert sorted(os.path.basename(r.original_path) for r in again.actions(spark).collect()) == ["b", "c"]
    assert actions.stage(plan, again) == (1, 0) and again.last_id() == 3
    assert actions.restore(again.actions(spark)) == 3 and sorted(os.listdir(src)) == ["a", "b", "c", "d"]


def test_report(spark, small, tmp_path):
    t = [spark.read.parquet(f"{small}/{x}.parquet") for x in ("scans", "files", "duplicate_groups", "duplicate_members", "actions")]
    lines = actions.run_report(*t)
    for (scan,) in t[0].select("id").collect():
        path = str(tmp_path / f"{scan}.json")
        actions.write_report(lines, scan, path)
        body = json.loads(open(path).read())
        mine = lambda df: df.filter(F.col("scan_id") == scan)
        assert body["formatVersion"] == "1" and body["runId"] == scan
        assert len(body["files"]) == mine(t[1]).count() and len(body["actions"]) == mine(t[4]).count()
        listed = t[3].select("group_id", "file_id").distinct().join(mine(t[2]).select(F.col("id").alias("group_id")), "group_id").count()
        assert [g["id"] for g in body["duplicateGroups"]] == [r.id for r in mine(t[2]).orderBy("id").collect()] and sum(len(g["members"]) for g in body["duplicateGroups"]) == listed
    actions.write_report_html(store.results_rows(*t[:4]).filter("run_id = 1"), "a <run>", str(tmp_path / "r.html"))
    assert "a &lt;run&gt;" in (tmp_path / "r.html").read_text()


def test_hashes_of_odd_files(spark, tmp_path):
    big = os.urandom(5000)
    write(tmp_path, **{"with blank_dot_txt": b"x", "per%20cent": b"y", "plus+": b"z", "große": big})
    listed = list_files(spark, [str(tmp_path)])
    got = {os.path.basename(r.path): r for r in hash_files(listed.select("path").union(spark.createDataFrame([("/no/such",), (None,)], "path string")), whole=True).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert {k: (r.hash_partial, r.hash_full) for k, r in got.items()} == {
        "with blank.txt": (sha(b"x"),) * 2, "per%20cent": (sha(b"y"),) * 2, "plus+": (sha(b"z"),) * 2, "große": (sha(big[:4096]), sha(big)), "such": (None, None),
    }


def test_a_provider_that_fails_half_way_is_an_error(spark):
    from siftmill.sources import provider

    def broken(root):
        yield "x", 1, dt.datetime(2020, 1, 1)
        raise OSError

    provider.PROVIDERS["broken"] = broken
    reader = provider.ProviderReader("broken", ["r"])
    with pytest.raises(OSError):
        list(reader.read(reader.partitions()[0]))
    del provider.PROVIDERS["broken"]


def test_stream_keeps_the_latest_row(spark, tmp_path):
    schema = "id long, path string, size long, modified_at timestamp_ntz, hash_partial string, hash_full string"
    at, source = dt.datetime(2020, 1, 1), str(tmp_path / "in")
    table = LatestFiles(spark, str(tmp_path / "table"))
    shape = spark.createDataFrame([], schema).schema
    for batch in ([(1, "a", 5, at, "p", "f"), (2, "b", 5, at, "q", None)], [(3, "a", 5, at, None, None), (4, "b", 6, at, None, None)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        follow_listings(spark, source, shape, table, str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(tuple(r)[:1] + (r.path, r.hash_partial) for r in table.read().collect()) == [(3, "a", "p"), (4, "b", None)]


def test_stream_survives_a_new_checkpoint_and_writes_changed_parts_only(spark, tmp_path):
    schema = "id long, path string, size long, modified_at timestamp_ntz, hash_partial string, hash_full string"
    at, source = dt.datetime(2020, 1, 1), str(tmp_path / "in")
    shape = spark.createDataFrame([], schema).schema
    add = lambda *rows: spark.createDataFrame([(i, p, 5, at, h, None) for i, p, h in rows], schema).coalesce(1).write.mode("append").parquet(source)
    follow = lambda cp: follow_listings(spark, source, shape, LatestFiles(spark, str(tmp_path / "table"), 8), str(tmp_path / cp)).awaitTermination(60)
    have = lambda: {r.path: (r.id, r.hash_partial) for r in LatestFiles(spark, str(tmp_path / "table"), 8).read().collect()}
    add(*((i, f"p{i}", f"h{i}") for i in range(40)))
    follow("one")
    assert len(have()) == 40
    add((100, "p1", None))
    follow("two")  # a new checkpoint sees all listings again and counts its batches from 0
    assert have()["p1"] == (100, "h1") and len(have()) == 40
    table = LatestFiles(spark, str(tmp_path / "table"), 8)
    before = table.note()
    table.merge(spark.createDataFrame([(101, "p2", 5, at, None, None)], schema), list(before["batches"])[-1], 0)
    assert table.note() == before  # a repeated batch
    table.merge(spark.createDataFrame([(101, "p2", 5, at, None, None), (102, None, 5, at, None, None)], schema), "three", 0)
    after = table.note()
    assert sum(before["at"][p] != v for p, v in after["at"].items()) == 1 and have()["p2"] == (101, "h2") and len(have()) == 40
