"""Continuous re-scan: listings that arrive as files are merged into the latest row of each path."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from siftmill.operators.store import latest_by_path, reuse_fingerprints
from siftmill.shared import delete_path
from siftmill.versions import current_version, listed_versions, read_note, version_path, write_note

#: Parts of the table by path; a merge rewrites those that its rows fall into.
PARTS = 64


class LatestFiles:
    """The latest row of each path, in parts by path. A version holds the parts that its merge changed and a note that
    says in which version each part is now, and which batch of which query was merged last."""

    def __init__(self, spark: SparkSession, folder: str, parts: int = PARTS):
        self.spark, self.folder, self.parts = spark, folder.rstrip("/"), parts

    def note(self) -> dict:
        """The current version's note; of an empty table before the first merge."""
        v = current_version(self.spark, self.folder)
        return read_note(self.spark, self.folder, v) or {"version": -1, "parts": self.parts, "at": {}, "batches": {}}

    def _read(self, note: dict, parts: list[int] | None = None) -> DataFrame | None:
        wanted = [(p, v) for p, v in note["at"].items() if parts is None or int(p) in parts]
        if not wanted:
            return None
        schema = StructType.fromJson(note["schema"])
        return self.spark.read.schema(schema).parquet(*(f"{version_path(self.folder, v)}/part={p}" for p, v in wanted))

    def read(self) -> DataFrame | None:
        """All rows; None before the first merge."""
        return self._read(self.note())

    def merge(self, rows: DataFrame, query: str = "", batch: int | None = None) -> None:
        """Take in listed rows: of each path the row with the highest id stays, and hashes of unchanged files are taken
        over. A batch of a query that was merged before is passed over; another query's batches are its own. Only the
        parts touched are read and written; what neither this version nor the one before names is deleted.
        """
        note = self.note()
        if batch is not None and note["batches"].get(query, -1) >= batch:
            return
        part = F.pmod(F.xxhash64("path"), F.lit(note["parts"])).cast("int")
        rows = rows.filter("path is not null")
        touched = sorted(r[0] for r in rows.select(part.alias("p")).distinct().collect())  # at most as many as parts
        old = self._read(note, touched)
        new = rows
        if old is not None:
            hashes = reuse_fingerprints(rows, old).select("id", F.col("hash_partial").alias("p"), F.col("hash_full").alias("f"))
            new = rows.join(hashes, "id", "left").withColumn("hash_partial", F.coalesce("hash_partial", "p")).withColumn("hash_full", F.coalesce("hash_full", "f")).select(*rows.columns)
            new = old.select(*rows.columns).unionByName(new)
        v = (listed_versions(self.spark, self.folder) or [-1])[-1] + 1
        at = {**note["at"], **{str(p): v for p in touched}}
        batches = note["batches"] if batch is None else {**note["batches"], query: batch}
        target = version_path(self.folder, v)
        latest_by_path(new).withColumn("part", part).repartition("part").write.partitionBy("part").parquet(target)
        write_note(self.spark, self.folder, v, {"version": v, "parts": note["parts"], "at": at, "batches": batches, "schema": rows.schema.jsonValue()})
        self._sweep(at, note["at"], v)

    def _sweep(self, now: dict, before: dict, current: int) -> None:
        used = {(v, p) for at in (now, before) for p, v in at.items()}
        for v in listed_versions(self.spark, self.folder):
            mine = {p for u, p in used if u == v}
            if v < current - 1 and not mine:
                delete_path(self.spark, version_path(self.folder, v))
            elif v < current:
                for p in (read_note(self.spark, self.folder, v) or {"at": {}})["at"]:
                    if p not in mine:
                        delete_path(self.spark, f"{version_path(self.folder, v)}/part={p}")


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id a checkpoint folder gives its query; another folder is another query, whose batches count from 0."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/metadata")
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode().splitlines()[0])["id"]
    finally:
        stream.close()


def follow_listings(spark: SparkSession, source: str, schema: StructType, table: LatestFiles, checkpoint: str) -> StreamingQuery:
    """Merge every new file of ``source`` (parquet listings) and stop when all there are have been merged."""
    stream = spark.readStream.schema(schema).parquet(source)
    sink = stream.writeStream.foreachBatch(lambda df, batch: table.merge(df, _query_id(spark, checkpoint), batch))
    return sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
