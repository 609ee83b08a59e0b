"""The file store: tables of runs, files, groups, members and actions in versions below one folder.

Runs are a log of changes, read as their latest state; the other tables grow by appended parts. A part, or a table put in
the place of another, counts from the moment its note is written.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmill.operators.runs import current_state
from siftmill.shared import cut, delete_path
from siftmill.versions import current_version, listed_versions, read_note, version_path, write_note

TABLES = {
    "scans": "id long, seq long, phase string, archive_root string, run_label string, settings_hash string, created_at timestamp_ntz, completed_at timestamp_ntz, last_heartbeat timestamp_ntz",
    "files": "id long, scan_id long, path string, provider string, size long, modified_at timestamp_ntz, mime_type string, hash_partial string, hash_full string, minhash_signature binary, copy_hint string",
    "duplicate_groups": "id long, scan_id long, canonical_file_id long, strategy string, confidence double",
    "duplicate_members": "group_id long, file_id long, confidence double",
    "actions": "id long, scan_id long, action_type string, file_id long, destination string, original_path string, executed_at timestamp_ntz, undone boolean, cleaned boolean, purged boolean",
}


def numbered(rows: DataFrame, order: list[Column], first: int) -> DataFrame:
    """``rows`` with ``id`` from ``first`` on in the given order, without gaps. Ranges of the order are numbered in
    parallel; only their counts, one a partition, reach the driver."""
    placed = cut(rows.repartitionByRange(*order).withColumn("__at", F.spark_partition_id()), "numbering").df
    counts, start = sorted(placed.groupBy("__at").count().collect()), {}
    for at, n in counts:
        start[at], first = first, first + n
    offsets = rows.sparkSession.createDataFrame(list(start.items()), "__at int, __first long")
    n = F.row_number().over(Window.partitionBy("__at").orderBy(*order)) - 1
    return placed.join(F.broadcast(offsets), "__at").withColumn("id", F.col("__first") + n).drop("__at", "__first")


class FileStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _parts(self, table: str) -> list[int]:
        v = current_version(self.spark, f"{self.folder}/{table}")
        return (read_note(self.spark, f"{self.folder}/{table}", v) or {"parts": []})["parts"]

    def log(self, table: str) -> DataFrame:
        """The stored rows of a table."""
        parts = [version_path(f"{self.folder}/{table}", v) for v in self._parts(table)]
        return self.spark.read.schema(TABLES[table]).parquet(*parts) if parts else self.spark.createDataFrame([], TABLES[table])

    def read(self, table: str) -> DataFrame:
        """The table as of now; of runs their latest state."""
        rows = self.log(table)
        return current_state(rows) if table == "scans" else rows

    def _write(self, table: str, rows: DataFrame, keep: list[int]) -> None:
        home = f"{self.folder}/{table}"
        v = (listed_versions(self.spark, home) or [-1])[-1] + 1
        columns = [c.split()[0] for c in TABLES[table].split(", ")]
        have = set(rows.columns)
        rows = rows.select(*(F.col(c) if c in have else F.lit(None).alias(c) for c in columns))
        types = dict(c.split() for c in TABLES[table].split(", "))
        rows.select(*(F.col(c).cast(types[c]).alias(c) for c in columns)).write.parquet(version_path(home, v))
        write_note(self.spark, home, v, {"parts": [*keep, v]})

    def append(self, table: str, rows: DataFrame) -> None:
        """Add rows in one distributed write; missing columns are null, others are left out."""
        self._write(table, rows, self._parts(table))

    def replace(self, table: str, rows: DataFrame) -> None:
        """Put rows in the table's place; the parts before are deleted."""
        before = self._parts(table)
        self._write(table, rows, [])
        for v in before:
            delete_path(self.spark, version_path(f"{self.folder}/{table}", v))

    def next_id(self, table: str) -> int:
        return int(self.log(table).agg(F.max("id")).first()[0] or 0) + 1

    # ------------------------------------------------------------ runs

    def begin_run(self, archive_root: str | None, label: str | None = None, settings_hash: str | None = None, now: datetime | None = None) -> int:
        """A new run in phase SCANNING; its id."""
        run, now = self.next_id("scans"), now or datetime.now()
        label = label or f"run_{now:%Y%m%d_%H%M%S}"
        self._log_run((run, 1, "SCANNING", archive_root, label, settings_hash, now, None, now))
        return run

    def _log_run(self, row: tuple) -> None:
        self.append("scans", self.spark.createDataFrame([row], TABLES["scans"]))

    def update_run(self, run: int, **changes) -> None:
        """Change fields of a run; every change is a row of the log and a heartbeat."""
        last = self.log("scans").filter(F.col("id") == run).orderBy(F.col("seq").desc()).first()
        if last is None:
            raise KeyError(run)
        names = [c.split()[0] for c in TABLES["scans"].split(", ")]
        row = {**last.asDict(), "last_heartbeat": datetime.now(), **changes, "seq": last.seq + 1}
        self._log_run(tuple(row[n] for n in names))

    def drop_run(self, run: int) -> None:
        """Take a run that came to nothing out of the log."""
        rest = cut(self.log("scans").filter(F.col("id") != run), "scans-log")
        self.replace("scans", rest.df)

    def run(self, run: int | None = None) -> dict | None:
        """A run's state, by default the newest complete one's."""
        scans = self.read("scans")
        rows = scans.filter(F.col("id") == run) if run is not None else scans.filter("phase in ('COMPLETE', 'STAGED', 'CLEANED')")
        best = rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).first()
        return best.asDict() if best else None

    def flag(self, run: int, flag: str) -> None:
        """Set 'cleaned' or 'purged' on all actions of a run."""
        changed = self.log("actions").withColumn(flag, F.when(F.col("scan_id") == run, F.lit(True)).otherwise(F.col(flag)))
        self.replace("actions", cut(changed, "actions").df)

    def dismiss(self, groups: DataFrame) -> None:
        """Take groups (group_id) and their members out."""
        gone = cut(groups.select("group_id").distinct(), "dismissed").df
        members = cut(self.log("duplicate_members").join(gone, "group_id", "left_anti"), "kept-members").df
        kept = cut(self.log("duplicate_groups").join(gone.withColumnRenamed("group_id", "id"), "id", "left_anti"), "kept-groups").df
        self.replace("duplicate_members", members)
        self.replace("duplicate_groups", kept)
