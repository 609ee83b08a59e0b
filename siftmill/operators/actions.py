"""Carrying out an archive plan on the local file system, and taking it back.

Plans are DataFrames (``store.archive_plan``); files are moved one by one on the driver, which streams the plan and logs
every move before and after it, and never holds either whole.
"""

from __future__ import annotations

import json
import os
import shutil
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ACTIONS = "id long, scan_id long, action_type string, file_id long, destination string, original_path string, executed_at timestamp_ntz, undone boolean, cleaned boolean, purged boolean"


class ActionLog:
    """A log of moves on the local file system: a line before each move and one after it, each on disk before the next
    step. So whatever interrupts a run, the log says where every file is."""

    def __init__(self, path: str):
        self.path = path
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        self._file = None

    def write(self, **line) -> None:
        if self._file is None:
            self._file = open(self.path, "a", encoding="utf-8")
        self._file.write(json.dumps(line) + "\n")
        self._file.flush()
        os.fsync(self._file.fileno())

    def close(self) -> None:
        if self._file is not None:
            self._file.close()
            self._file = None

    def actions(self, spark: SparkSession) -> DataFrame:
        """The moves done, as rows of ACTIONS: those logged as done, and those begun whose file is found moved."""
        if not os.path.exists(self.path):
            return spark.createDataFrame([], ACTIONS)
        lines = spark.read.schema(f"state string, {ACTIONS}").json(f"file://{os.path.abspath(self.path)}")
        moved = F.udf(lambda d, o: bool(d) and os.path.isfile(d) and not os.path.exists(o or ""), "boolean")
        last = lines.filter("id is not null").groupBy("id").agg(F.max_by(F.struct(*lines.columns), F.when(F.col("state") == "begun", 0).otherwise(1)).alias("r")).select("r.*")
        done = last.filter((F.col("state") == "done") | ((F.col("state") == "begun") & moved("destination", "original_path")))
        return done.drop("state").select(*[c.split()[0] for c in ACTIONS.split(", ")])

    def last_id(self) -> int:
        last = 0
        if os.path.exists(self.path):
            with open(self.path, encoding="utf-8") as f:
                for line in f:
                    try:
                        last = max(last, int(json.loads(line)["id"]))
                    except (ValueError, KeyError):
                        continue  # a line cut off by a crash
        return last


def move_new(source: str, destination: str) -> None:
    """Move a file; an existing destination is an error, and is never written over."""
    os.makedirs(os.path.dirname(destination), exist_ok=True)
    try:
        os.link(source, destination)  # fails if the destination exists, without a gap between look and leap
    except FileExistsError:
        raise
    except OSError:  # another device, or no hard links
        with open(source, "rb") as a, open(destination, "xb") as b:
            shutil.copyfileobj(a, b, 8 << 20)
            b.flush()
            os.fsync(b.fileno())
        shutil.copystat(source, destination)
    os.unlink(source)


def stage(plan: DataFrame, log: ActionLog) -> tuple[int, int]:
    """Carry out a plan; (files moved, files that failed). Of a source planned more than once the first membership
    counts. Missing sources are passed over; an existing destination fails that file. The plan is streamed in order and
    what was done is in the log, so neither is held on the driver."""
    once = plan.filter("source is not null and destination is not null").groupBy("source").agg(F.min(F.struct("scan_id", "group_id", "file_id", "destination")).alias("p"))
    done = failed = 0
    number = log.last_id()
    for r in once.select("source", "p.*").orderBy("scan_id", "group_id", "file_id").toLocalIterator():
        if not os.path.isfile(r.source):
            continue
        number += 1
        line = {
            "id": number, "scan_id": r.scan_id, "action_type": "MOVE", "file_id": r.file_id, "destination": r.destination, "original_path": r.source,
            "executed_at": datetime.now().isoformat(timespec="microseconds"), "undone": False, "cleaned": False, "purged": False,
        }
        log.write(state="begun", **line)
        try:
            move_new(r.source, r.destination)
        except OSError:
            log.write(state="failed", **line)
            failed += 1
            continue
        log.write(state="done", **line)
        done += 1
    log.close()
    return done, failed


def restore(actions: DataFrame) -> int:
    """Move back what ``store.movable_back`` names, unless its archive copy is gone or its place is taken."""
    n = 0
    for r in actions.toLocalIterator():
        if r.destination and r.original_path and os.path.isfile(r.destination):
            try:
                move_new(r.destination, r.original_path)
            except OSError:
                continue
            n += 1
    return n


def purge(archive_root: str, scan_id: int, confirmed: bool = False) -> bool:
    """Delete a run's archive folder; only when confirmed."""
    if not archive_root:
        return False
    folder = os.path.join(archive_root, f"run_{int(scan_id)}")
    if not confirmed or not os.path.isdir(folder):
        return False
    shutil.rmtree(folder)
    return True


def run_report(scan: DataFrame, files: DataFrame, groups: DataFrame, members: DataFrame, actions: DataFrame) -> DataFrame:
    """Lines (scan_id, section, part, line) that make one JSON document for each run in ``scan`` when written in order:
    header, files, groups with members, actions.

    No row holds more than one file, member or action, so a run may be of any size; ``write_report`` streams them into a
    document.
    """
    c = F.col
    one = lambda df, section, part, *fields: df.select("scan_id", F.lit(section).alias("section"), F.struct(*part).alias("part"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("line"))
    key = lambda a, b=None: (a.cast("long").alias("a"), (F.lit(None).cast("long") if b is None else b.cast("long")).alias("b"))
    head = scan.select(c("id").alias("scan_id"), "run_label", "phase", "created_at", "completed_at", "archive_root")
    runs = head.select("scan_id").distinct()
    mine = lambda df: df.join(runs, "scan_id", "left_semi")
    listed = members.groupBy("group_id", "file_id").agg(F.max("confidence").alias("confidence")).join(groups.select(c("id").alias("group_id"), "scan_id"), "group_id")
    return (
        one(head, 0, key(c("scan_id")), F.lit("1").alias("formatVersion"), c("scan_id").alias("runId"), c("run_label").alias("runLabel"), "phase", c("created_at").alias("createdAt"), c("completed_at").alias("completedAt"), c("archive_root").alias("archiveRoot"))
        .unionByName(one(mine(files), 1, key(c("id")), "id", "path", "size", c("mime_type").alias("mimeType"), c("hash_full").alias("hashFull"), c("copy_hint").alias("copyHint")))
        .unionByName(one(mine(groups), 2, key(c("id")), "id", "strategy", "confidence", c("canonical_file_id").alias("canonicalFileId")))
        .unionByName(one(mine(listed), 2, key(c("group_id"), F.coalesce(c("file_id"), F.lit(-1))), c("file_id").alias("fileId"), "confidence"))
        .unionByName(one(mine(actions), 3, key(c("id")), "id", c("file_id").alias("fileId"), c("action_type").alias("actionType"), c("original_path").alias("originalPath"), "destination", c("executed_at").alias("executedAt")))
    )


def write_report(lines: DataFrame, scan_id: int, path: str) -> None:
    """One run's document, streamed from the sorted lines."""
    names = {1: "files", 2: "duplicateGroups", 3: "actions"}
    with open(path, "w", encoding="utf-8") as f:
        at, first, in_group = 0, True, False
        for r in lines.filter(F.col("scan_id") == scan_id).orderBy("section", F.col("part.a").asc_nulls_last(), F.col("part.b").asc_nulls_first(), "line").toLocalIterator():
            if r.section == 0:
                f.write(r.line[:-1])
                continue
            while at < r.section:
                f.write("]}" if in_group else "")
                f.write(("]" if at else "") + f', "{names[at + 1]}": [')
                at, first, in_group = at + 1, True, False
            if r.section == 2 and r.part.b is None:
                f.write(("]}" if in_group else "") + ("" if first else ", ") + r.line[:-1] + ', "members": [')
                first, in_group, first_member = False, True, True
            elif r.section == 2:
                f.write(("" if first_member else ", ") + r.line)
                first_member = False
            else:
                f.write(("" if first else ", ") + r.line)
                first = False
        f.write("]}" if in_group else "")
        while at < 3:
            f.write(("]" if at else "") + f', "{names[at + 1]}": [')
            at += 1
        f.write("]}")


def write_report_html(rows: DataFrame, head: str, path: str) -> None:
    """A plain page of one run's ``store.results_rows``, streamed in order."""
    from html import escape

    with open(path, "w", encoding="utf-8") as f:
        f.write(f"<!doctype html><meta charset='utf-8'><h1>{escape(head)}</h1><table><tr><th>group</th><th>strategy</th><th>role</th><th>path</th><th>size</th></tr>")
        n = 0
        for r in rows.orderBy("group_index", "role", "path").toLocalIterator():
            n += 1
            f.write(f"<tr><td>{r.group_index}</td><td>{escape(str(r.strategy))}</td><td>{r.role}</td><td>{escape(r.path or '')}</td><td>{r.size}</td></tr>")
        f.write(f"</table><p>{n} rows</p>")


def free_bytes(path: str) -> int:
    """Free bytes at the nearest existing folder of a path, -1 if unknown."""
    while path and not os.path.exists(path):
        parent = os.path.dirname(path)
        path = "" if parent == path else parent
    try:
        return shutil.disk_usage(path).free if path else -1
    except OSError:
        return -1
