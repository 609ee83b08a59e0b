"""The whole chain on trees of files: scan, results, stage, cleanup, purge, and scanning again."""

import csv
import io
import json
import os

import pytest
from pyspark.sql import functions as F
from test_sources import png, write

from siftmill import handlers
from siftmill.__main__ import CSV_HEADER, main
from siftmill.operators import runs
from siftmill.operators.filestore import FileStore, numbered
from siftmill.pipeline import Settings


@pytest.fixture
def home(spark, tmp_path):
    """A tree of duplicates, its store and its archive, and a way to run commands on them."""

    def run(*args):
        out = io.StringIO()
        code = main([*args, "--store", str(tmp_path / "store")], out, spark)
        return code, out.getvalue()

    words = [f"w{i}" for i in range(400)]
    page = lambda w: ("<html><body>" + " ".join(w) + "</body></html>").encode()
    slope = [[(x * 3 + y) % 256 for x in range(64)] for y in range(64)]
    other = [row[:] for row in slope]
    for y in range(8):
        other[y] = [255 - v if x < 32 else v for x, v in enumerate(other[y])]
    tree = tmp_path / "tree"
    write(tree, a_dot_txt=b"same", sub__b_dot_txt=b"same", **{'q"uote_dot_txt': b"same"}, lone_dot_txt=b"only")
    write(tree, one_dot_html=page(words), two_dot_html=page([*words[:390], "x", "y", "z"]), far_dot_html=page([f"v{i}" for i in range(400)]))
    write(tree, up_dot_png=png(slope), up2_dot_png=png(other))
    return run, FileStore(spark, str(tmp_path / "store")), tree, tmp_path / "archive"


def test_scan_stage_cleanup_purge(spark, home):
    run, s, tree, archive = home
    assert run("scan", str(tree), str(tree / "missing"), "--archive", str(archive)) == (0, "run 1\n")
    files = {os.path.basename(r.path): r for r in s.read("files").collect()}
    assert len(files) == 9 and sorted(r.id for r in files.values()) == list(range(1, 10))
    assert len(files["one.html"].minhash_signature) == 1024 and len(files["up.png"].minhash_signature) == 8 and files["a.txt"].minhash_signature is None
    assert files["lone.txt"].hash_full is None or files["lone.txt"].hash_full != files["a.txt"].hash_full
    groups = {r.strategy: r for r in s.read("duplicate_groups").collect()}
    assert set(groups) == {"exact-hash", "near-dup-document", "near-dup-image"} and groups["exact-hash"].confidence == 1.0
    names = {r.id: n for n, r in files.items()}
    members = {}
    for r in s.read("duplicate_members").collect():
        members.setdefault(r.group_id, set()).add(names[r.file_id])
    assert {k: members[g.id] for k, g in groups.items()} == {"exact-hash": {"a.txt", "b.txt", 'q"uote.txt'}, "near-dup-document": {"one.html", "two.html"}, "near-dup-image": {"up.png", "up2.png"}}

    code, text = run("results", "-o", "csv")
    lines = list(csv.reader(io.StringIO(text)))
    assert tuple(lines[0]) == CSV_HEADER and len(lines) == 8 and {os.path.basename(x[6]) for x in lines[1:]} >= {'q"uote.txt', "one.html"}
    assert len(json.loads(run("results", "1", "-o", "json")[1])) == 7 and "keep" in run("results")[1]
    assert run("results", "77") == (1, "no such run\n")

    before = sorted(str(p) for p in tree.rglob("*"))
    dry = run("stage", "--dry-run")[1].splitlines()
    assert len(dry) == 4 and all("  →  " in x for x in dry) and before == sorted(str(p) for p in tree.rglob("*")) and not archive.exists()
    assert run("stage") == (0, "4 moved, 0 failed\n")
    assert s.run(1)["phase"] == "STAGED" and s.read("actions").count() == 4 and len([p for p in tree.rglob("*") if p.is_file()]) == 5
    report = json.loads((archive / "run_1" / "report.json").read_text())
    assert len(report["files"]) == 9 and len(report["duplicateGroups"]) == 3 and len(report["actions"]) == 4
    assert (archive / "run_1" / "report.html").exists()
    assert run("stage") == (0, "0 moved, 0 failed\n") and s.read("actions").count() == 4

    assert run("cleanup", "--all") == (0, "run 1: 4 moved back\n")
    assert before == sorted(str(p) for p in tree.rglob("*")) and s.run(1)["phase"] == "CLEANED" and s.read("actions").filter("cleaned").count() == 4
    assert run("purge", "1", "--yes") == (0, "run 1: archive deleted\n") and not (archive / "run_1").exists()
    assert s.read("actions").filter("purged").count() == 4 and s.run(1)["phase"] == "PURGED"


def test_scanning_again(spark, home):
    run, s, tree, archive = home
    assert run("scan", str(tree), "--archive", str(archive))[1] == "run 1\n"
    assert run("scan", str(tree), "--archive", str(archive))[1] == "run 1\n"  # nothing changed
    assert run("scan", str(tree), "--archive", str(archive), "--threshold", "0.9")[1] == "run 2\n"  # other settings
    write(tree, new_dot_txt=b"same")
    assert run("scan", str(tree), "--archive", str(archive), "--threshold", "0.9")[1] == "run 3\n"
    n = s.read("files").groupBy("scan_id").count().orderBy("scan_id").collect()
    assert [tuple(r) for r in n] == [(1, 9), (2, 9), (3, 10)] and s.read("files").select("id").distinct().count() == 28
    largest = s.read("duplicate_members").groupBy("group_id").count().agg(F.max("count")).first()[0]
    assert largest == 4 and json.loads(run("history", "3")[1])["n_groups"] == 3 and json.loads(run("report", "3")[1])["n_files"] == 10


def test_a_failed_run_says_so(spark, home, monkeypatch):
    run, s, tree, archive = home
    monkeypatch.setattr("siftmill.pipeline._store_groups", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run("scan", str(tree), "--archive", str(archive))
    assert s.read("scans").first().phase == "FAILED" and s.run() is None and runs.in_progress(s.read("scans")).count() == 0
    s.drop_run(1)
    assert s.read("scans").count() == 0 and s.begin_run("/x") == 1
    assert runs.in_progress(s.read("scans")).first().id == 1


def test_store_numbers_and_dismisses(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    got = numbered(rows, [F.col("x")], 50).collect()
    assert sorted((r.x, r.id) for r in got) == [(x, 50 + x) for x in range(1000)]
    s = FileStore(spark, str(tmp_path))
    s.append("duplicate_groups", spark.createDataFrame([(1, 1), (2, 1)], "id long, scan_id long"))
    s.append("duplicate_members", spark.createDataFrame([(1, 5), (2, 5)], "group_id long, file_id long"))
    s.append("duplicate_members", spark.createDataFrame([(2, 6)], "group_id long, file_id long"))
    s.dismiss(spark.createDataFrame([(2,), (9,)], "group_id long"))
    assert [r.id for r in s.read("duplicate_groups").collect()] == [1] and [(r.group_id, r.file_id) for r in s.read("duplicate_members").collect()] == [(1, 5)]
    with pytest.raises(KeyError):
        s.update_run(4, phase="X")


def test_settings_and_handlers(spark):
    assert Settings(0.9, 0.6).fingerprint() == "0.9|0.6"
    for bad in ({"min_similarity": 0.4}, {"min_similarity": 1.0}, {"threshold": 1.5}):
        with pytest.raises(ValueError):
            Settings(**bad)
    mine = handlers.Handler("audio", lambda m: m.startswith("audio/"))
    handlers.register(mine)
    try:
        df = spark.createDataFrame([("audio/ogg",), ("text/html",), ("image/png",), ("x/y",), (None,)], "m string")
        assert [r[0] for r in df.select(handlers.handler_name(F.col("m"))).collect()] == ["audio", "document", "image", "generic", "generic"]
    finally:
        handlers.HANDLERS.remove(mine)
