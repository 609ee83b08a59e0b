"""Queries on heavy keys, snapshots and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftmill.operators import heavy_keys, references, snapshots
from siftmill.plans.tables import read


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys.heavy_candidate_keys(read(spark, d, "files"))


def p2_key_results(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys.candidate_key_results(read(spark, d, "files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.path_changes(read(spark, d, "files"), read(spark, d, "scans")).select("scan_id", "path", "change_kind")


def p4_changes(spark: SparkSession, d: str) -> DataFrame:
    files = read(spark, d, "files")
    return snapshots.with_values(snapshots.path_changes(files, read(spark, d, "scans")), files)


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_records(*(read(spark, d, t) for t in ("files", "duplicate_groups", "duplicate_members", "scans")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(_orphans(spark, d))


def queries():
    return {f.__name__: f for f in (p2_found, p2_key_results, p4_found, p4_changes, p5_found, p5_report)}


_KEYS = """
select size, lower(trim(hash_partial)) as hash_partial, count(*) as n_rows, count(distinct lower(trim(hash_full))) as n_values,
       coalesce(sum(size), 0)::bigint as total_size, count(*) >= 0.02 * (select count(*) from files) as is_heavy
from files group by 1, 2"""

_CHANGES = """
with s as (
  select id as scan_id, archive_root as r, row_number() over (partition by archive_root order by created_at, id) as k
  from scans where phase = 'COMPLETE' and archive_root is not null),
f as (
  select r, k, path, max(id) as id from files join s using (scan_id) where path is not null group by r, k, path),
v as (select f.*, size, modified_at, date_trunc('second', modified_at) as sec from f join files using (id)),
j as (
  select coalesce(a.r, b.r) as r, coalesce(a.k, b.k + 1) as k, coalesce(a.path, b.path) as path,
         case when b.id is null then 'added' when a.id is null then 'removed'
              when a.size is distinct from b.size or a.sec is distinct from b.sec then 'changed' end as change_kind,
         a.size as new_size, a.modified_at as new_modified_at, b.size as old_size, b.modified_at as old_modified_at
  from (select r, k, v.path, v.id, v.size, v.modified_at, sec from v) a
  full join (select r, k, v.path, v.id, v.size, v.modified_at, sec from v) b on a.r = b.r and a.k = b.k + 1 and a.path = b.path)
select s.scan_id, {cols} from j join s on s.r = j.r and s.k = j.k where change_kind is not null and j.k > 1"""

_ORPHANS = """
select 'files' as table_name, id as record_id, scan_id as ref_id, coalesce(strftime(modified_at, '%Y-%m'), 'unknown') as period_month
from files where scan_id is not null and not exists (select 1 from scans s where s.id = files.scan_id)
union
select 'duplicate_groups', g.id, canonical_file_id, coalesce(strftime(s.created_at, '%Y-%m'), 'unknown')
from duplicate_groups g left join scans s on s.id = g.scan_id
where canonical_file_id is not null and not exists (select 1 from files f where f.id = canonical_file_id)
union
select 'duplicate_members', m.group_id, m.file_id, coalesce(strftime(s.created_at, '%Y-%m'), 'unknown')
from duplicate_members m left join duplicate_groups g on g.id = m.group_id left join scans s on s.id = g.scan_id
where m.file_id is not null and not exists (select 1 from files f where f.id = m.file_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"select size, hash_partial from ({_KEYS}) where is_heavy and hash_partial is not null",
        "p2_key_results": _KEYS,
        "p4_found": _CHANGES.format(cols="path, change_kind"),
        "p4_changes": _CHANGES.format(cols="path, change_kind, new_size, new_modified_at, old_size, old_modified_at"),
        "p5_found": _ORPHANS,
        "p5_report": f"select table_name, period_month, count(*) as n_records, count(distinct ref_id) as n_keys from ({_ORPHANS}) group by 1, 2",
    }
