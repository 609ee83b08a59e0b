"""Reads of the file store: latest records, reuse of earlier fingerprints, previews, reports, plans of moves.

Every operator works on all scans at once; filter its result, or its inputs, for one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmill.functions.columns import ancestors, archive_path, copy_hint, csv_quoted
from siftmill.operators.snapshots import completed_snapshots, path_changes, seconds


#: Roots that are compared with as literals; more are joined.
FEW_ROOTS = 5000


def latest_by_path(files: DataFrame) -> DataFrame:
    """The row with the highest id of each path (null paths have none). Give only the columns needed: all travel."""
    cols = [c for c in files.columns if c != "path"]
    best = files.filter("path is not null").groupBy("path").agg(F.max_by(F.struct(*cols), "id").alias("r"))
    return best.select("path", *(F.col("r")[c].alias(c) for c in cols)).select(*files.columns)


def reuse_fingerprints(current: DataFrame, cached: DataFrame) -> DataFrame:
    """(id, path, reused, hash_partial, hash_full): hashes taken over from the latest cached row of the path where its
    partial hash is known and size and modified_at (to the second) are equal; null means to be computed."""
    old = latest_by_path(cached.select("id", "path", "size", "modified_at", "hash_partial", "hash_full")).select("path", F.col("size").alias("o_size"), seconds(F.col("modified_at")).alias("o_at"), F.col("hash_partial").alias("o_part"), F.col("hash_full").alias("o_full"))
    same = F.col("o_part").isNotNull() & (F.col("size") == F.col("o_size")) & (seconds(F.col("modified_at")) == F.col("o_at"))
    hit = F.coalesce(same, F.lit(False))
    return current.join(old, "path", "left").select("id", "path", hit.alias("reused"), F.when(hit, F.col("o_part")).alias("hash_partial"), F.when(hit, F.col("o_full")).alias("hash_full"))


def unchanged_scans(files: DataFrame, scans: DataFrame) -> DataFrame:
    """(scan_id, n_changes, unchanged) of every completed scan that has one before it."""
    changes = path_changes(files, scans).groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"))
    later = completed_snapshots(scans).filter("turn > 1").select("scan_id")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return later.join(changes, "scan_id", "left").select("scan_id", n.alias("n_changes"), (n == 0).alias("unchanged"))


def exclude_under(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Files whose path is none of ``roots`` (root) and lies below none, by whole components; null paths stay."""
    clean = roots.select(F.regexp_replace("root", "/+$", "").alias("root")).filter("root is not null").distinct()
    few = [r.root for r in clean.limit(FEW_ROOTS + 1).collect()]
    if len(few) <= FEW_ROOTS:  # a set of literals: rows are told apart in the scan, without a join
        return files.filter(F.col("path").isNull() | ~F.exists(ancestors(F.col("path")), lambda a: a.isin(few))) if few else files
    below = files.filter("path is not null").select("id", F.explode(ancestors(F.col("path"))).alias("root")).join(clean, "root", "left_semi").select("id").distinct()
    return files.join(below, "id", "left_anti")


def _members(groups: DataFrame, members: DataFrame) -> DataFrame:
    g = groups.select(F.col("id").alias("group_id"), "scan_id", "canonical_file_id", "strategy", F.col("confidence").alias("group_confidence"))
    return members.select("group_id", "file_id").distinct().join(g, "group_id")


def preview_summary(scans: DataFrame, files: DataFrame, groups: DataFrame, members: DataFrame, threshold: float = 0.95) -> DataFrame:
    """One row for each scan: files, groups by strategy and queue, files to remove and their bytes, each file once."""
    n = files.groupBy("scan_id").agg(F.count(F.lit(1)).alias("total_files"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    g = groups.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("total_groups"),
        count(F.col("strategy") == "exact-hash")("exact_groups"),
        count(F.col("strategy") != "exact-hash")("near_dup_groups"),
        F.avg("confidence").alias("avg_confidence"),
        count(F.col("confidence") >= threshold)("auto_queue"),
        count(F.col("confidence") < threshold)("review_queue"),
    )
    spare = _members(groups, members).filter("file_id <> canonical_file_id").select("scan_id", "file_id").distinct()
    sized = spare.join(files.select(F.col("id").alias("file_id"), "size"), "file_id", "left").groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("total_dupes"), F.coalesce(F.sum("size"), F.lit(0)).alias("reclaimable_bytes")
    )
    whole = ["total_files", "total_groups", "exact_groups", "near_dup_groups", "auto_queue", "review_queue", "total_dupes", "reclaimable_bytes"]
    out = scans.select(F.col("id").alias("scan_id")).join(n, "scan_id", "left").join(g, "scan_id", "left").join(sized, "scan_id", "left")
    return out.select("scan_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in whole), F.coalesce("avg_confidence", F.lit(0.0)).alias("avg_confidence"))


def preview_groups(files: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """Groups that have members in files: counts, bytes, the kept file's path and type."""
    kept = files.select(F.col("id").alias("canonical_file_id"), F.col("path").alias("canonical_path"), F.col("mime_type").alias("canonical_mime_type"))
    size = files.select(F.col("id").alias("file_id"), "size")
    spare = F.when(F.col("file_id") != F.col("canonical_file_id"), F.col("size")).otherwise(0)
    per = _members(groups, members).join(size, "file_id").groupBy("group_id").agg(
        F.count(F.lit(1)).alias("member_count"), F.coalesce(F.sum(spare), F.lit(0)).alias("reclaimable_bytes"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes")
    )
    g = groups.select(F.col("id").alias("group_id"), "scan_id", "strategy", "confidence", "canonical_file_id")
    return g.join(per, "group_id").join(kept, "canonical_file_id", "left").withColumn("dupe_count", F.col("member_count") - 1)


def preview_members(scans: DataFrame, files: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """Members with their file, role and, unless kept, the path they would be moved to."""
    info = files.select(F.col("id").alias("file_id"), "path", "size", "modified_at", "mime_type")
    runs = scans.select(F.col("id").alias("scan_id"), "archive_root")
    kept = F.coalesce(F.col("file_id") == F.col("canonical_file_id"), F.lit(False))
    rows = _members(groups, members).join(info, "file_id").join(runs, "scan_id")
    return rows.select("group_id", "file_id", "path", "size", "modified_at", "mime_type", kept.alias("is_canonical"), F.when(~kept, archive_path(F.col("archive_root"), F.col("scan_id"), F.col("path"))).alias("archive_path"))


def report_totals(scans: DataFrame, files: DataFrame, groups: DataFrame, members: DataFrame, actions: DataFrame) -> DataFrame:
    """Per scan: files, bytes, groups, recoverable bytes and explicit copies (each membership counts), moves."""
    n = files.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("total_bytes"))
    g = groups.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n_groups"))
    info = files.select(F.col("id").alias("file_id"), "size", "copy_hint")
    spare = _members(groups, members).filter("not (file_id <=> canonical_file_id)").join(info, "file_id").groupBy("scan_id").agg(
        F.sum("size").alias("recoverable_bytes"), F.sum(F.when(F.col("copy_hint") == "explicit_copy", 1).otherwise(0)).alias("explicit_copies")
    )
    moves = actions.filter(F.upper(F.trim("action_type")) == "MOVE").groupBy("scan_id").agg(F.countDistinct("id").alias("staged"))
    cols = ["n_files", "total_bytes", "n_groups", "recoverable_bytes", "explicit_copies", "staged"]
    out = scans.select(F.col("id").alias("scan_id"))
    for part in (n, g, spare, moves):
        out = out.join(part, "scan_id", "left")
    return out.select("scan_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in cols))


def run_history(scans: DataFrame, files: DataFrame, groups: DataFrame) -> DataFrame:
    """Every scan with its numbers of files and groups, those with none included."""
    n = files.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n_files"))
    g = groups.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n_groups"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return scans.select(F.col("id").alias("scan_id"), "run_label", "phase").join(n, "scan_id", "left").join(g, "scan_id", "left").select("scan_id", "run_label", "phase", zero("n_files"), zero("n_groups"))


def groups_with_members(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Groups with an array of their members (file_id, confidence), by file_id.

    The array is what this operator returns, so a group is as large as its row; the reports above do without it.
    """
    listed = members.groupBy("group_id", "file_id").agg(F.max("confidence").alias("confidence")).groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("file_id", "confidence"))).alias("members"))
    return groups.join(listed.withColumnRenamed("group_id", "id"), "id", "left")


def _first_of_each(rows: DataFrame, group: str, order: Column, k: int) -> DataFrame:
    """The first k rows of each group with their ``place``. Rows are cut to k within salted parts of a group first, so no
    task sorts a large group."""
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(64))
    part = Window.partitionBy(group, "__salt").orderBy(order)
    few = rows.withColumn("__salt", salt).withColumn("__n", F.row_number().over(part)).filter(F.col("__n") <= k)
    return few.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("place") <= k).drop("__salt", "__n")


def least_certain(groups: DataFrame, k: int) -> DataFrame:
    """The k groups of each run of the least confidence, unknown ones first, with their ``place``."""
    return _first_of_each(groups.select("id", "scan_id", "strategy", "confidence", "canonical_file_id"), "scan_id", F.struct("confidence", "id"), k)


def kept_first(groups: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The first k members (group_id, file_id, place) of each group: the kept file, then the others by id."""
    rows = _members(groups, members).filter("file_id is not null").select("group_id", "file_id", (~F.col("file_id").eqNullSafe(F.col("canonical_file_id"))).alias("other"))
    return _first_of_each(rows, "group_id", F.struct("other", "file_id"), k)


def archive_plan(scans: DataFrame, files: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """(scan_id, group_id, file_id, source, destination) of every membership that is not the kept one."""
    return preview_members(scans, files, groups, members).filter("not is_canonical").join(
        groups.select(F.col("id").alias("group_id"), "scan_id"), "group_id"
    ).select("scan_id", "group_id", "file_id", F.col("path").alias("source"), F.col("archive_path").alias("destination"))


def movable_back(actions: DataFrame) -> DataFrame:
    """Moves that were neither cleaned nor purged."""
    return actions.filter((F.upper(F.trim("action_type")) == "MOVE") & ~F.coalesce("cleaned", F.lit(False)) & ~F.coalesce("purged", F.lit(False)))


def mark(actions: DataFrame, scan_id: int, flag: str) -> DataFrame:
    """Actions with a flag ('cleaned' or 'purged') set for one scan."""
    return actions.withColumn(flag, F.when(F.col("scan_id") == scan_id, F.lit(True)).otherwise(F.col(flag)))


def dismiss(groups: DataFrame, members: DataFrame, dismissed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups and members without the groups named in ``dismissed`` (group_id)."""
    gone = dismissed.select("group_id").distinct()
    return groups.join(gone.withColumnRenamed("group_id", "id"), "id", "left_anti"), members.join(gone, "group_id", "left_anti")


def results_rows(scans: DataFrame, files: DataFrame, groups: DataFrame, members: DataFrame, quoted: bool = True) -> DataFrame:
    """Lines of the results export, with paths quoted for CSV unless the writer does that: run, group number within the run by id, strategy, confidence, role, path, size."""
    number = F.row_number().over(Window.partitionBy("scan_id").orderBy("id"))
    numbered = groups.select(F.col("id").alias("group_id"), number.alias("group_index"))
    info = files.select(F.col("id").alias("file_id"), "path", "size")
    rows = _members(groups, members).join(numbered, "group_id").join(info, "file_id").join(scans.select(F.col("id").alias("scan_id"), "run_label"), "scan_id")
    role = F.when(F.col("file_id") == F.col("canonical_file_id"), "canonical").otherwise("duplicate")
    return rows.select(
        F.col("scan_id").alias("run_id"), "run_label", "group_index", "strategy", F.format_string("%.4f", F.coalesce("group_confidence", F.lit(0.0))).alias("confidence"), role.alias("role"), (csv_quoted(F.col("path")) if quoted else F.col("path")).alias("path"), "size"
    )


def hinted_copies(files: DataFrame) -> DataFrame:
    return files.select("id", copy_hint(F.col("path")).alias("copy_hint"))
