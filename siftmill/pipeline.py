"""The whole chain over a file tree: list, hash, fingerprint, compare, cluster, store."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill import handlers
from siftmill.functions.columns import clean_mime
from siftmill.operators.dedup import MAX_CLUSTER, exact_groups, exact_links, keep_order, near_duplicate_groups
from siftmill.operators.filestore import FileStore, numbered
from siftmill.operators.graph import lookup
from siftmill.operators.snapshots import seconds
from siftmill.operators.store import reuse_fingerprints
from siftmill.shared import cut
from siftmill.sources.files import hash_files, list_files


@dataclass(frozen=True)
class Settings:
    """Confidence from which a group needs no review, and the least similarity of near duplicates."""

    threshold: float = 0.95
    min_similarity: float = 0.5

    def __post_init__(self):
        if not 0.5 <= self.min_similarity < 1 or not 0 <= self.threshold <= 1:
            raise ValueError("min_similarity lies in [0.5, 1), threshold in [0, 1]")

    def fingerprint(self) -> str:
        return f"{self.threshold}|{self.min_similarity}"


def scan_tree(spark: SparkSession, roots: list[str], scan_id: int = 1, excluded: list[str] = (), cached: DataFrame | None = None, first_id: int = 1) -> DataFrame:
    """files rows of one scan, without fingerprints of likeness. Partial hashes are computed where a size is shared, full
    hashes where size and partial hash are; those of ``cached`` files that did not change are taken over."""
    listed = cut(list_files(spark, roots, excluded), "listing")
    rows = cut(numbered(listed.df, [F.col("path")], first_id), "files-numbered").df
    if cached is not None:
        known = reuse_fingerprints(rows, cached).select("path", F.col("hash_partial").alias("k_part"), F.col("hash_full").alias("k_full"))
        rows = rows.join(known, "path", "left")
    else:
        rows = rows.withColumns({"k_part": F.lit(None).cast("string"), "k_full": F.lit(None).cast("string")})
    twins = rows.groupBy(F.col("size").alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k", F.lit(True).alias("r"))
    marked = lookup(rows, "size", twins, listed.rows)
    heads = hash_files(marked.filter("r and k_part is null")).select("path", F.col("hash_partial").alias("h_part"))
    part = cut(marked.join(heads, "path", "left").withColumn("hash_partial", F.coalesce("k_part", "h_part")).drop("r", "k_part", "h_part"), "files-heads")
    pair = F.when(F.col("hash_partial").isNotNull(), F.concat_ws("/", "size", "hash_partial"))
    keyed = part.df.withColumn("pair", pair)
    same = keyed.filter("pair is not null").groupBy(F.col("pair").alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k", F.lit(True).alias("r"))
    close = lookup(keyed, "pair", same, part.rows)
    wholes = hash_files(close.filter("r and k_full is null"), whole=True).select("path", F.col("hash_full").alias("w_full"))
    full = close.join(wholes, "path", "left").withColumn("hash_full", F.coalesce("k_full", "w_full"))
    return full.select("id", F.lit(scan_id).cast("long").alias("scan_id"), "path", "provider", "size", "modified_at", "mime_type", "hash_partial", "hash_full", "copy_hint")


def duplicates(spark: SparkSession, roots: list[str], excluded: list[str] = ()) -> DataFrame:
    """Groups of identical files below the roots and the file to keep of each."""
    return exact_groups(scan_tree(spark, roots, excluded=excluded))


def unchanged(listed: DataFrame, before: DataFrame) -> bool:
    """Whether a listing has the paths of the files before, each with its size and modified_at to the second."""
    side = lambda df, p: df.groupBy("path").agg(F.max(F.struct("size", seconds(F.col("modified_at")).alias("at"))).alias(p))
    both = side(listed, "now").join(side(before, "then"), "path", "full_outer")
    return both.filter("not (now <=> then)").limit(1).count() == 0


def near_pairs(files: DataFrame, min_similarity: float) -> DataFrame:
    """Links (a, b, similarity, strategy) of all handlers' near duplicates, each other member of a class of copies being
    linked with the lowest of the other class, so links grow with members and not with their pairs."""
    out = None
    rows = files.select("id", clean_mime(F.col("mime_type")).alias("kind"), "size", F.col("minhash_signature").alias("fp")).filter("fp is not null")
    for h in handlers.HANDLERS:
        if h.links is None:
            continue
        mine = cut(rows.filter(handlers.handler_name(F.col("kind")) == h.name), "near-records")
        if not mine.rows:
            continue
        links = cut(h.links(mine.df, min_similarity).select("id_a", "id_b", "similarity"), "near-links")
        # classes of the links: records alike in kind, size and fingerprint, or in kind and fingerprint for fingerprints
        # that say nothing of the size; the lowest id names a class either way
        named = mine.df.select(F.col("id"), F.concat_ws("/", "kind", *(["size"] if h.name == "document" else []), F.hex("fp")).alias("key"))
        first = named.groupBy(F.col("key").alias("k")).agg(F.min("id").alias("r"))
        members = cut(lookup(named, "key", first, mine.rows).select("id", F.col("r").alias("class_id")), "near-members")
        both = links.df.select(F.col("id_a").alias("class_id"), F.col("id_b").alias("other"), "similarity").union(links.df.select("id_b", "id_a", "similarity"))
        spread = both.join(members.df, "class_id").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "similarity", F.lit(h.strategy).alias("strategy")).distinct()
        out = spread if out is None else out.unionByName(spread)
    return out if out is not None else files.sparkSession.createDataFrame([], "a long, b long, similarity double, strategy string")


def run_scan(store: FileStore, roots: list[str], archive_root: str, settings: Settings = Settings(), excluded: list[str] = (), label: str | None = None, force: bool = False) -> int:
    """One run over the roots, its files, groups and members stored; the run's id.

    If the newest complete run had the same settings and archive root and nothing changed since, no run is stored and its
    id is returned, unless ``force``. The archive is no part of the scan. Exact and near-duplicate pairs are clustered
    apart, the latter by strategy. A failure leaves the run in phase FAILED.
    """
    spark, excluded = store.spark, [*excluded, archive_root]
    last = store.run()
    if not force and last and last["settings_hash"] == settings.fingerprint() and last["archive_root"] == archive_root:
        if unchanged(list_files(spark, roots, excluded), store.read("files").filter(F.col("scan_id") == last["id"])):
            return last["id"]
    run = store.begin_run(archive_root, label, settings.fingerprint())
    try:
        cached = store.read("files").select("id", "path", "size", "modified_at", "hash_partial", "hash_full")
        rows = cut(scan_tree(spark, roots, run, excluded, cached, store.next_id("files")), "files-hashed").df
        store.update_run(run, phase="COMPARING")
        prints = None
        for h in handlers.HANDLERS:
            if h.fingerprint is not None:
                mine = rows.filter(handlers.handler_name(clean_mime(F.col("mime_type"))) == h.name).select("path")
                got = h.fingerprint(spark, mine, roots).select("path", F.col("fp").alias("minhash_signature"))
                prints = got if prints is None else prints.unionByName(got)
        files = cut(rows.join(prints, "path", "left") if prints is not None else rows.withColumn("minhash_signature", F.lit(None).cast("binary")), "files-printed").df
        store.append("files", files)
        store.update_run(run, phase="CLUSTERING")
        _store_groups(store, run, files, settings)
        store.update_run(run, phase="COMPLETE", completed_at=datetime.now())
    except BaseException:
        store.update_run(run, phase="FAILED")
        raise
    return run


def _store_groups(store: FileStore, run: int, files: DataFrame, settings: Settings) -> None:
    classes = exact_links(files)
    kept = classes.join(files.select("id", "size", "modified_at", "path"), "id").groupBy("class_id").agg(F.min(keep_order()).alias("k"))
    groups = kept.select(F.lit("exact-hash").alias("strategy"), F.col("class_id").alias("key"), F.col("k.id").alias("canonical_file_id"), F.lit(1.0).alias("confidence"))
    members = classes.select(F.lit("exact-hash").alias("strategy"), F.col("class_id").alias("key"), F.col("id").alias("file_id"))
    pairs = cut(near_pairs(files, settings.min_similarity), "near-pairs").df
    for h in handlers.HANDLERS:
        if h.strategy is None:
            continue
        mine = pairs.filter(F.col("strategy") == h.strategy).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
        g, m = near_duplicate_groups(mine, files, settings.threshold, MAX_CLUSTER)
        groups = groups.unionByName(g.select(F.lit(h.strategy).alias("strategy"), F.col("group_id").alias("key"), "canonical_file_id", "confidence"))
        members = members.unionByName(m.select(F.lit(h.strategy).alias("strategy"), F.col("group_id").alias("key"), "file_id"))
    named = cut(numbered(groups, [F.col("strategy"), F.col("key")], store.next_id("duplicate_groups")), "groups-numbered")
    label = F.concat_ws("/", "strategy", "key")
    ids = named.df.select(label.alias("k"), F.struct("id", "confidence").alias("r"))
    listed = cut(members.withColumn("label", label), "members-labelled")
    placed = lookup(listed.df, "label", ids, listed.rows)
    store.append("duplicate_groups", named.df.withColumn("scan_id", F.lit(run)))
    store.append("duplicate_members", placed.select(F.col("r.id").alias("group_id"), "file_id", F.col("r.confidence").alias("confidence")))
