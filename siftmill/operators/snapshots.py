"""What changed between full snapshots, from a bucketed index of key to hash.

The index holds for each key of each series of snapshots a hash of its compared values and where its row is, bucketed by
key. A delivered snapshot's rows probe it: a key without entry was added, an entry without row removed, a differing hash
changed. The same join gives the entries of the next index, which takes the old one's place once it is written. Old
values are fetched by row id for changes only. The index lies in a folder of the caller's and serves later sessions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmill.shared import bounded, cut, table_path
from siftmill.versions import VersionedTable, buckets_for

KEY = ["series", "key"]


def seconds(c: Column) -> Column:
    return F.date_trunc("SECOND", c)


def value_hash(*values: Column) -> Column:
    """128 bits of the values, nulls told from any value."""
    text = F.concat_ws("\x01", *(F.coalesce(v.cast("string"), F.lit("\x00")) for v in values))
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def key_entries(rows: DataFrame, series: str, turn: str, key: str, row_id: str, values: list[Column]) -> DataFrame:
    """One entry (series, turn, key, row_id, hash) for each key of each snapshot: its row with the highest id.

    Rows with a null key have no identity and make no entry; a null id counts as the lowest.
    """
    best = F.max(F.struct(F.col(row_id).alias("row_id"), value_hash(*values).alias("hash"))).alias("e")
    return (
        rows.filter(F.col(key).isNotNull())
        .groupBy(F.col(series).alias("series"), F.col(turn).alias("turn"), F.col(key).alias("key"))
        .agg(best)
        .select("series", "turn", "key", "e.row_id", "e.hash")
    )


class SnapshotIndex:
    """The index of the last snapshot of every series, in versions below ``folder``.

    A version's rows are (series, key, row_id, hash) as of its delivery and (turn, change_kind, old_id), how the key came
    to differ from the version before; removed keys stay for one version, without a hash.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.table = spark, VersionedTable(spark, folder, KEY)

    def advance(self, entries: DataFrame, delivered: DataFrame, n_delivered: int, buckets: int | None = None) -> DataFrame:
        """Take in one delivery: (series, turn, key, change_kind, row_id, old_id) against the index kept, which the
        delivery then replaces.

        ``entries`` (series, key, row_id, hash) are the rows delivered, ``delivered`` (series, turn) the ``n_delivered``
        snapshots, one for each series, so that an empty one removes all; other series stay as they are. Turn 1 is a
        series' first snapshot and has no changes. The index before stays readable until ``retire``. ``buckets`` is for
        a new index; one that has outgrown its buckets by far is given more.
        """
        before = self.table.version()
        note = self.table.note(before) or {}
        count = note.get("buckets") or buckets or buckets_for(entries.count())
        if buckets_for(note.get("rows", 0)) > 2 * count:
            count = buckets_for(note["rows"])
        came = bounded(delivered.select("series", F.col("turn").cast("long").alias("turn")), n_delivered)
        new = entries.select(*KEY, "row_id", "hash", F.lit(True).alias("now"))
        old = self.table.read(before)
        if old is None:
            both = new.withColumns({"o_id": F.lit(None).cast("long"), "o_hash": F.lit(None).cast("binary")})
        else:
            kept = old.filter("hash is not null").select(*KEY, F.col("row_id").alias("o_id"), F.col("hash").alias("o_hash"))
            both = new.join(kept, KEY, "full_outer")
        there = F.col("turn").isNotNull()
        kind = F.when(F.coalesce(F.col("turn"), F.lit(1)) < 2, F.lit(None)).when(F.col("now").isNull(), "removed").when(F.col("o_hash").isNull(), "added").when(F.col("hash") != F.col("o_hash"), "changed")
        after = both.join(came, "series", "left").select(
            *KEY,
            F.when(there, F.col("row_id")).otherwise(F.col("o_id")).alias("row_id"),
            F.when(there, F.col("hash")).otherwise(F.col("o_hash")).alias("hash"),
            "turn",
            kind.cast("string").alias("change_kind"),
            F.when(there, F.col("o_id")).alias("old_id"),
        )
        v = self.table.write(after.filter("hash is not null or change_kind is not null"), count, arranged=note.get("buckets") == count)
        return self.table.read(v).filter("change_kind is not null").select("series", "turn", "key", "change_kind", "row_id", "old_id")

    def retire(self) -> None:
        """Delete the indexes that have been replaced, once what was found with them has been written."""
        self.table.retire()


def completed_snapshots(scans: DataFrame) -> DataFrame:
    """(scan_id, series, turn, later): completed scans of each archive root numbered by created_at, then id."""
    done = scans.filter((F.col("phase") == "COMPLETE") & F.col("archive_root").isNotNull() & F.col("created_at").isNotNull() & F.col("id").isNotNull())
    one = done.groupBy(F.col("id").alias("scan_id")).agg(F.min("archive_root").alias("series"), F.min("created_at").alias("created_at"))
    order = Window.partitionBy("series").orderBy("created_at", "scan_id")
    return one.select("scan_id", "series", F.row_number().over(order).cast("long").alias("turn"))


def path_changes(files: DataFrame, scans: DataFrame, folder: str | None = None) -> DataFrame:
    """(scan_id, path, change_kind, row_id, old_id) between consecutive completed scans of each archive root.

    'changed' compares size and modified_at cut to seconds, null being equal to null only. Of a path listed twice the
    row with the highest id counts; rows without a path are ignored. A first scan has no changes; a scan that lists
    nothing removes every path of the one before. Empty tables give no rows.

    The history is replayed as it was delivered: the k-th scans of all roots are one delivery, so the rounds are as many
    as the longest series has scans. Rows are arranged in the index's buckets once; no later round shuffles them. The
    index is left in ``folder``, by default one below the shared folder that ends with the application.
    """
    spark = files.sparkSession
    folder = folder or table_path(spark, "snapshots")
    snapshots = cut(completed_snapshots(scans), "snapshots")
    last = snapshots.df.agg(F.max("turn")).first()[0]
    if last is None:
        return spark.createDataFrame([], "scan_id long, path string, change_kind string, row_id long, old_id long")
    buckets = buckets_for(files.count())
    rows = files.select("id", "scan_id", "path", "size", "modified_at").filter("path is not null").join(bounded(snapshots.df, snapshots.rows), "scan_id")
    placed = rows.withColumnRenamed("path", "key").repartition(buckets, *KEY)
    entries = key_entries(placed, "series", "turn", "key", "id", [F.col("size"), seconds(F.col("modified_at"))])
    staged = VersionedTable(spark, f"{folder}/delivered", KEY)
    staged.write(entries.sortWithinPartitions("turn"), buckets, arranged=True)
    index, found = SnapshotIndex(spark, f"{folder}/index"), []
    sizes = dict(snapshots.df.groupBy("turn").count().collect())  # as many rows as the longest series has scans
    for turn in range(1, last + 1):
        due = staged.read().filter(F.col("turn") == turn)
        found.append(index.advance(due, snapshots.df.filter(F.col("turn") == turn), sizes.get(turn, 0), buckets))
    changes = reduce(DataFrame.unionByName, found)
    return changes.join(bounded(snapshots.df, snapshots.rows), ["series", "turn"]).select("scan_id", F.col("key").alias("path"), "change_kind", "row_id", "old_id")


def with_values(changes: DataFrame, files: DataFrame) -> DataFrame:
    """Changes with old and new size and modified_at; only rows of changed, removed or added paths are fetched."""
    side = lambda k, p: files.select(F.col("id").alias(k), F.col("size").alias(f"{p}_size"), F.col("modified_at").alias(f"{p}_modified_at"))
    return changes.join(side("row_id", "new"), "row_id", "left").join(side("old_id", "old"), "old_id", "left").drop("row_id", "old_id")
