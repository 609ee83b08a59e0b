"""Bucketed tables kept in versions below a folder: the state of operators that serve one delivery after another.

A version is complete once its note is written, after its data; the newest complete one is current. So a new version
takes the old one's place in one step, a driver lost half-way leaves the old one current, and any later session that
names the folder goes on from there.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siftmill.shared import delete_path

#: Rows that one bucket should hold; beyond MAX_BUCKETS buckets grow instead.
ROWS_PER_BUCKET = 1_000_000
MIN_BUCKETS, MAX_BUCKETS = 8, 65_536


def buckets_for(rows: int) -> int:
    """The power of two of buckets for so many rows."""
    return min(MAX_BUCKETS, max(MIN_BUCKETS, 1 << max(0, (rows - 1) // ROWS_PER_BUCKET).bit_length()))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def version_path(folder: str, version: int) -> str:
    return f"{folder}/v{version:08d}"


def listed_versions(spark: SparkSession, folder: str) -> list[int]:
    """All versions below a folder, complete or not, in order."""
    p, fs = _fs(spark, folder)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def read_note(spark: SparkSession, folder: str, version: int) -> dict | None:
    """What was noted with a version; None if it is not complete."""
    p, fs = _fs(spark, f"{version_path(folder, version)}/_note.json")
    if version < 0 or not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def write_note(spark: SparkSession, folder: str, version: int, note: dict) -> None:
    """Complete a version."""
    p, fs = _fs(spark, f"{version_path(folder, version)}/_note.json")
    part, _ = _fs(spark, f"{version_path(folder, version)}/_note.tmp")
    out = fs.create(part, True)
    try:
        out.write(bytearray(json.dumps(note).encode()))
    finally:
        out.close()
    if not fs.rename(part, p):
        raise OSError(f"cannot complete {version_path(folder, version)}")


def current_version(spark: SparkSession, folder: str) -> int:
    """The newest complete version, -1 if there is none."""
    return next((v for v in reversed(listed_versions(spark, folder)) if read_note(spark, folder, v) is not None), -1)


class VersionedTable:
    """A table below ``folder``, bucketed by ``keys``."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str]):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys
        self._names: dict[int, str] = {}

    def path(self, version: int) -> str:
        return version_path(self.folder, version)

    def note(self, version: int) -> dict | None:
        return read_note(self.spark, self.folder, version)

    def version(self) -> int:
        return current_version(self.spark, self.folder)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, the current one if none is named; None if there is none."""
        v = self.version() if version is None else version
        note = self.note(v) if v >= 0 else None
        if note is None:
            return None
        if v not in self._names:  # a later session than the writer's does not know the table yet
            name = f"siftmill_{uuid.uuid4().hex[:16]}"
            keys = ", ".join(f"`{k}`" for k in self.keys)
            self.spark.sql(
                f"create table {name} ({note['schema']}) using parquet clustered by ({keys}) into {note['buckets']} buckets location '{self.path(v)}'"
            )
            self._names[v] = name
        return self.spark.table(self._names[v])

    def write(self, rows: DataFrame, buckets: int, arranged: bool = False, **note) -> int:
        """Write the next version and make it current; its number. ``arranged`` rows are in their buckets already. The note
        holds the number of rows, the buckets, the schema and what is given."""
        v = (listed_versions(self.spark, self.folder) or [-1])[-1] + 1
        name = f"siftmill_{uuid.uuid4().hex[:16]}"
        placed, seen = rows if arranged else rows.repartition(buckets, *self.keys), Observation()
        placed.observe(seen, F.count(F.lit(1)).alias("rows")).write.bucketBy(buckets, *self.keys).option("path", self.path(v)).format("parquet").saveAsTable(name)
        self._names[v] = name
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        write_note(self.spark, self.folder, v, {**note, "rows": int(seen.get.get("rows") or 0), "buckets": buckets, "schema": schema})
        return v

    def retire(self, before: int | None = None) -> None:
        """Delete the versions before one (the current one if none is named); nothing lazy may read them any more."""
        last = self.version() if before is None else before
        for v in listed_versions(self.spark, self.folder):
            if v < last:
                if v in self._names:
                    self.spark.sql(f"drop table if exists {self._names.pop(v)}")
                delete_path(self.spark, self.path(v))
