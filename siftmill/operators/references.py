"""References to records that do not exist, from signed counts per key.

A ledger holds for every (target table, key) how many records refer to it and how many records have it. It is built
and kept up by adding signed deltas: +1 for a row that appeared, -1 for one that went. Keys with references and
without existence are the orphans; the records that name them are reported by table and month. The ledger is stored in a
folder of the caller's and serves later sessions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.operators.graph import lookup
from siftmill.shared import cut, join_by_key, table_path
from siftmill.versions import VersionedTable, buckets_for

KEY = ["target", "key"]


def references(rows: DataFrame, ref: str, target: str, sign: Column | int = 1) -> DataFrame:
    """Delta of the references a table's rows make; null references make none."""
    s = sign if isinstance(sign, Column) else F.lit(sign)
    return rows.filter(F.col(ref).isNotNull()).select(
        F.lit(target).alias("target"), F.col(ref).cast("long").alias("key"), s.cast("long").alias("refs"), F.lit(0).cast("long").alias("here")
    )


def existences(rows: DataFrame, key: str, target: str, sign: Column | int = 1) -> DataFrame:
    """Delta of the records a table's rows are; null keys are none."""
    s = sign if isinstance(sign, Column) else F.lit(sign)
    return rows.filter(F.col(key).isNotNull()).select(
        F.lit(target).alias("target"), F.col(key).cast("long").alias("key"), F.lit(0).cast("long").alias("refs"), s.cast("long").alias("here")
    )


def apply_deltas(ledger: DataFrame | None, *deltas: DataFrame) -> DataFrame:
    """The ledger with deltas added; keys whose counts are both zero drop out. Sums are combined before the shuffle."""
    all_ = reduce(DataFrame.unionByName, [*([ledger] if ledger is not None else []), *deltas])
    return all_.groupBy("target", "key").agg(F.sum("refs").alias("refs"), F.sum("here").alias("here")).filter("refs <> 0 or here <> 0")


def orphan_keys(ledger: DataFrame) -> DataFrame:
    """(target, key, refs) of the keys referred to that do not exist."""
    return ledger.filter("refs > 0 and here <= 0").select("target", "key", "refs")


class ReferenceLedger:
    """The ledger as a bucketed table in versions below ``folder``; a merge shuffles the delta only."""

    def __init__(self, spark: SparkSession, folder: str):
        self.table = VersionedTable(spark, folder, KEY)

    def advance(self, *deltas: DataFrame) -> None:
        """Add deltas to the counts kept. Keys whose counts are both zero drop out. A ledger that has outgrown its
        buckets by far is given more; the version before is deleted."""
        change = cut(apply_deltas(None, *deltas), "ledger-delta")
        before = self.table.version()
        note = self.table.note(before) or {}
        rows = int(note.get("rows", 0)) + change.rows
        count = note.get("buckets") or buckets_for(rows)
        if buckets_for(rows) > 2 * count:
            count = buckets_for(rows)
        delta, old = change.df.repartition(count, *KEY), self.table.read(before)
        if old is not None:
            delta = delta.select(*KEY, F.col("refs").alias("d_refs"), F.col("here").alias("d_here"))
            total = lambda c: (F.coalesce(c, F.lit(0)) + F.coalesce(f"d_{c}", F.lit(0))).alias(c)
            delta = old.join(delta, KEY, "full_outer").select(*KEY, total("refs"), total("here")).filter("refs <> 0 or here <> 0")
        self.table.write(delta, count, arranged=old is None or note.get("buckets") == count)
        change.drop()
        self.table.retire()

    def counts(self) -> DataFrame | None:
        """(target, key, refs, here), None if nothing was ever added."""
        return self.table.read()


def _month(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM"), F.lit("unknown"))


def file_store_ledger(files: DataFrame, groups: DataFrame, members: DataFrame, scans: DataFrame, folder: str | None = None) -> ReferenceLedger:
    """Ledger of files.scan_id, duplicate_groups.canonical_file_id and duplicate_members.file_id, filled from two
    deliveries as a store makes them: a scan with its files, then the groups found among them."""
    ledger = ReferenceLedger(files.sparkSession, folder or table_path(files.sparkSession, "ledger"))
    ledger.advance(existences(scans, "id", "scans"), existences(files, "id", "files"), references(files, "scan_id", "scans"))
    ledger.advance(references(groups, "canonical_file_id", "files"), references(members, "file_id", "files"))
    return ledger


def orphan_records(files: DataFrame, groups: DataFrame, members: DataFrame, scans: DataFrame, ledger: ReferenceLedger | None = None) -> DataFrame:
    """(table_name, record_id, ref_id, period_month) of every record whose reference has no row, distinct.

    The month is that of files.modified_at, for groups and members that of the group's scan; 'unknown' where it is
    null, or the group or its scan is missing. Null references are none. Repeated rows come out once. ``ledger`` is one
    kept up to these tables; without one it is filled from them.
    """
    orphans = cut(orphan_keys((ledger or file_store_ledger(files, groups, members, scans)).counts()), "orphans", {"refs": F.col("refs")})
    rows = orphans.sums["refs"]
    to_scans = orphans.df.filter("target = 'scans'").select(F.col("key").alias("ref_id"), "refs")
    to_files = orphans.df.filter("target = 'files'").select(F.col("key").alias("ref_id"), "refs")
    started = scans.filter("id is not null").groupBy(F.col("id").alias("scan_id")).agg(F.max("created_at").alias("at"))
    from_files = join_by_key(
        files.filter("scan_id is not null").select(
            F.lit("files").alias("table_name"), F.col("id").alias("record_id"), F.col("scan_id").alias("ref_id"), _month(F.col("modified_at")).alias("period_month")
        ),
        to_scans, "ref_id", "refs", rows, "left_semi",
    )
    named = groups.select(F.col("id").alias("record_id"), "scan_id", F.col("canonical_file_id").alias("ref_id"))
    lost_groups = join_by_key(named.filter("ref_id is not null"), to_files, "ref_id", "refs", rows, "left_semi")
    from_groups = lost_groups.join(started, "scan_id", "left").select(F.lit("duplicate_groups").alias("table_name"), "record_id", "ref_id", _month(F.col("at")).alias("period_month"))
    listed = members.filter("file_id is not null").select(F.col("group_id").alias("record_id"), F.col("file_id").alias("ref_id")).distinct()
    lost = join_by_key(listed, to_files, "ref_id", "refs", rows, "left_semi")
    run_of = groups.filter("id is not null").groupBy(F.col("id").alias("k")).agg(F.max("scan_id").alias("scan_id")).join(started, "scan_id", "left").select("k", F.col("at").alias("r"))
    from_members = lookup(lost, "record_id", run_of, rows).select(F.lit("duplicate_members").alias("table_name"), "record_id", "ref_id", _month(F.col("r")).alias("period_month"))
    return from_files.unionByName(from_groups).unionByName(from_members).select("table_name", "record_id", "ref_id", "period_month").distinct()


def orphan_report(records: DataFrame) -> DataFrame:
    """Orphan references by table and month: n_records and n_keys (distinct missing keys)."""
    per_key = records.groupBy("table_name", "period_month", "ref_id").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("table_name", "period_month").agg(F.sum("n").alias("n_records"), F.count(F.lit(1)).alias("n_keys"))
