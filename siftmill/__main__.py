"""Command line: ``python -m siftmill COMMAND ...``; every command names the folder of the file store with --store.

scan ROOT...            scan, compare and store a run        stage [RUN]     move duplicates to the archive
report, history, plan   read models as JSON lines            cleanup [RUN]   move them back
results [RUN]           duplicates as text, json or csv      purge [RUN]     delete a run's archive
"""

from __future__ import annotations

import argparse
import csv
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.operators import actions, store
from siftmill.operators.filestore import FileStore
from siftmill.pipeline import Settings, run_scan

CSV_HEADER = ("RunId", "RunLabel", "GroupIndex", "Strategy", "Confidence", "Role", "Path", "Size")
COMMANDS = ("scan", "report", "history", "results", "plan", "stage", "cleanup", "purge")


def _tables(s: FileStore) -> list[DataFrame]:
    return [s.read(t) for t in ("scans", "files", "duplicate_groups", "duplicate_members")]


def _run_id(s: FileStore, run: int | None) -> int | None:
    found = s.run(run)
    return found["id"] if found else None


def results(s: FileStore, run: int, form: str, out) -> None:
    """One run's results, streamed in order."""
    rows = store.results_rows(*_tables(s), quoted=False).filter(F.col("run_id") == run).orderBy("group_index", "role", "path")
    writer, first, group = csv.writer(out, lineterminator="\n"), True, None
    if form == "csv":
        out.write(",".join(CSV_HEADER) + "\n")
    for r in rows.toLocalIterator():
        if form == "csv":
            writer.writerow((r.run_id, r.run_label, r.group_index, r.strategy, r.confidence, r.role, r.path, r["size"]))
        elif form == "json":
            out.write(("[" if first else ",\n ") + json.dumps(r.asDict()))
        else:
            if r.group_index != group:
                out.write(f"group {r.group_index}  {r.strategy}  {r.confidence}\n")
            out.write(f"  {'keep' if r.role == 'canonical' else 'copy'}  {r.path}  ({r['size']} bytes)\n")
        first, group = False, r.group_index
    if form == "json":
        out.write("[]\n" if first else "]\n")


def stage(s: FileStore, run: int, archive: str | None, dry: bool, out) -> int:
    """Move a run's duplicates; files that failed. A dry run only prints the plan."""
    if archive and not dry:
        s.update_run(run, archive_root=archive)
    tables = _tables(s)
    if archive and dry:
        tables[0] = tables[0].withColumn("archive_root", F.when(F.col("id") == run, F.lit(archive)).otherwise(F.col("archive_root")))
    plan = store.archive_plan(*tables).filter(F.col("scan_id") == run)
    if dry:
        for r in plan.orderBy("group_id", "file_id").toLocalIterator():
            out.write(f"{r.source}  →  {r.destination}\n")
        return 0
    if not plan.limit(1).count():
        return 0
    root = s.run(run)["archive_root"]
    log = actions.ActionLog(f"{root}/run_{run}/moves.jsonl")
    moved, failed = actions.stage(plan, log)
    known = s.read("actions").filter(F.col("scan_id") == run).select("original_path", "destination")
    fresh = log.actions(s.spark).drop("id").join(known, ["original_path", "destination"], "left_anti")
    from siftmill.operators.filestore import numbered

    s.append("actions", numbered(fresh, [F.col("executed_at"), F.col("original_path")], s.next_id("actions")))
    s.update_run(run, phase="STAGED")
    one = [t.filter(F.col("id" if k == 0 else "scan_id") == run) for k, t in enumerate(_tables(s)[:3])]
    actions.write_report(actions.run_report(*one, s.read("duplicate_members"), s.read("actions").filter(F.col("scan_id") == run)), run, f"{root}/run_{run}/report.json")
    actions.write_report_html(store.results_rows(*_tables(s), quoted=False).filter(F.col("run_id") == run), f"run {run}", f"{root}/run_{run}/report.html")
    out.write(f"{moved} moved, {failed} failed\n")
    return failed


def cleanup(s: FileStore, run: int, out) -> None:
    n = actions.restore(store.movable_back(s.read("actions").filter(F.col("scan_id") == run)))
    s.flag(run, "cleaned")
    s.update_run(run, phase="CLEANED")
    out.write(f"run {run}: {n} moved back\n")


def purge(s: FileStore, run: int, confirmed: bool, out) -> None:
    if actions.purge(s.run(run)["archive_root"], run, confirmed):
        s.flag(run, "purged")
        s.update_run(run, phase="PURGED")
        out.write(f"run {run}: archive deleted\n")
    else:
        out.write(f"run {run}: nothing deleted\n")


def main(args: list[str] | None = None, out=None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="siftmill", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("what", nargs="*", help="roots to scan, or the number of a run; by default the newest")
    p.add_argument("--store", required=True, help="folder of the file store")
    p.add_argument("--archive", help="folder for duplicates that are moved")
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--threshold", type=float, default=0.95)
    p.add_argument("--min-similarity", type=float, default=0.5)
    p.add_argument("--force", action="store_true", help="scan even if nothing changed")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--all", action="store_true", help="every staged run")
    p.add_argument("--yes", action="store_true", help="purge without asking")
    p.add_argument("-o", "--output", choices=("text", "json", "csv"), default="text")
    a, out = p.parse_args(args), out or sys.stdout
    spark = spark or SparkSession.builder.appName("siftmill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s = FileStore(spark, a.store)
    if a.command == "scan":
        if not a.what or not a.archive:
            p.error("scan needs roots and --archive")
        out.write(f"run {run_scan(s, a.what, a.archive, Settings(a.threshold, a.min_similarity), a.exclude, force=a.force)}\n")
        return 0
    asked = int(a.what[0]) if a.what else None
    if a.command in ("report", "history"):
        df = store.report_totals(*_tables(s), s.read("actions")) if a.command == "report" else store.run_history(*_tables(s)[:3])
        for line in (df if asked is None else df.filter(F.col("scan_id") == asked)).orderBy("scan_id").toJSON().toLocalIterator():
            out.write(line + "\n")
        return 0
    if a.all and a.command in ("cleanup", "purge"):
        runs = [r.id for r in s.read("scans").filter("phase in ('STAGED', 'CLEANED')").select("id").orderBy("id").toLocalIterator()]
    else:
        runs = [_run_id(s, asked)]
    if runs == [None]:
        out.write("no such run\n")
        return 1
    failed = 0
    for run in runs:
        if a.command == "results":
            results(s, run, a.output, out)
        elif a.command in ("stage", "plan"):
            failed += stage(s, run, a.archive, a.dry_run or a.command == "plan", out)
        elif a.command == "cleanup":
            cleanup(s, run, out)
        else:
            purge(s, run, a.yes or input(f"delete the archive of run {run}? [y/N] ").strip().lower() == "y", out)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
