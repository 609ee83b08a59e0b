"""Pairs of records whose fingerprints agree in most positions, by adaptive multi-match prefixes.

A signature of ``positions`` values is a set of that many (position, value) tokens, so agreement in ``t`` positions
is an overlap of ``t`` tokens. Under one global token order, two sets with overlap >= t share at least L tokens
within their first ``positions - t + L`` tokens, for every L. Each record picks its own L: a longer prefix costs
postings, but lets verification wait for L shared tokens. A pair needs min(L_a, L_b) shared prefix tokens, which
loses nothing, as the shorter of the two prefixes already holds that many.

Exact copies (same group, same signature) are one class throughout and are expanded only in the last join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.operators.graph import lookup
from siftmill.shared import Table, cut, hot_limit, join_by_key

#: Counters of the frequency sketch: a fixed bound on what reaches the driver and each worker (8 MB).
SKETCH_MIN, SKETCH_MAX = 1 << 16, 1 << 21
#: Most shared tokens that a prefix may be lengthened to require.
MAX_LEVEL = 8
#: Cost of verifying one candidate, in posting hits.
VERIFY_COST = 12.0
#: Postings of one token that are joined within one block.
BLOCK = 2000
SALTS = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _tokens(sig: np.ndarray, grp: np.ndarray) -> np.ndarray:
    """64-bit token of each (group, position, value); sig is n x positions uint64, grp n uint64."""
    at = (np.arange(1, sig.shape[1] + 1, dtype=np.uint64) * _MIX)[None, :]
    h = (sig ^ at) + grp[:, None]
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(mul)
    return h ^ (h >> np.uint64(31))


def _batch(batch: pa.RecordBatch, positions: int) -> tuple[np.ndarray, np.ndarray]:
    raw = b"".join(batch.column("sig").to_pylist())
    sig = np.frombuffer(raw, dtype=">u8").astype(np.uint64).reshape(-1, positions)
    return sig, batch.column("grp_hash").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _counter(positions: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                at = (_tokens(*_batch(batch, positions)) & np.uint64(width - 1)).astype(np.int64)
                total += np.bincount(at.ravel(), minlength=width)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    return run


def choose_levels(freq: np.ndarray, base: int, max_level: int, verify_cost: float) -> np.ndarray:
    """For each row of ascending token frequencies (other records holding the token), the cheapest number of
    shared tokens: postings read plus candidates to verify, where a candidate of level L uses up L postings."""
    reached = np.cumsum(freq, axis=1)
    levels = np.arange(1, max_level + 1)
    hits = reached[:, base + levels - 1]
    return levels[np.argmin((base + levels) + hits + verify_cost * hits / levels, axis=1)]


def _poster(positions: int, width: int, counts, noise: float, base: int, max_level: int, verify_cost: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for batch in batches:
            if not batch.num_rows:
                continue
            tok = _tokens(*_batch(batch, positions))
            freq = table[(tok & np.uint64(width - 1)).astype(np.int64)].astype(np.uint64)
            rank = (np.minimum(freq, np.uint64((1 << 24) - 1)) << np.uint64(40)) | (tok >> np.uint64(24))
            # ties of the packed rank are broken by the token itself, so that the order is the same in every record
            order = np.lexsort((tok, rank), axis=1)
            tok, freq = np.take_along_axis(tok, order, 1), np.take_along_axis(freq, order, 1)
            level = choose_levels(np.maximum(freq.astype(np.float64) - 1 - noise, 0), base, max_level, verify_cost)
            keep = np.arange(positions)[None, :] < (base + level)[:, None]
            row = np.nonzero(keep)[0]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(tok[keep].view(np.int64)),
                    batch.column("key").take(pa.array(row)),
                    pa.array(level[row].astype(np.int8)),
                ],
                ["token", "key", "level"],
            )

    return run


def _verifier(positions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint64).reshape(-1, positions) for c in ("sig_a", "sig_b"))
            agree = (a == b).sum(axis=1).astype(np.int32)
            keep = [batch.column(c) for c in ("key_a", "key_b", "n_a", "n_b")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(agree)], ["key_a", "key_b", "n_a", "n_b", "agree"])

    return run


def _class_pairs(records: DataFrame, positions: int, min_agree: int, max_level: int, verify_cost: float) -> tuple[DataFrame, Table, DataFrame]:
    """(rows with their class key, classes, pairs of classes) of the records; see ``near_duplicate_pairs``."""
    spark, base = records.sparkSession, positions - min_agree
    rows = (
        records.select(F.col("id").cast("long").alias("id"), F.col("grp").cast("string").alias("grp"), "sig")
        .filter(F.col("id").isNotNull() & F.col("grp").isNotNull() & (F.octet_length("sig") == 8 * positions))
        .withColumn("key", F.unhex(F.substring(F.sha2(F.concat(F.encode("grp", "UTF-8"), F.lit(b"\x00"), "sig"), 256), 1, 32)))
    )
    classes = cut(
        rows.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.first("sig").alias("sig"), F.xxhash64(F.first("grp")).alias("grp_hash")),
        "neardup-classes",
        {"rows": F.col("n")},
    )
    sigs = classes.df
    width = min(SKETCH_MAX, max(SKETCH_MIN, 1 << max(0, classes.rows * positions // 4).bit_length()))
    tokens = sigs.select("sig", "grp_hash")
    buckets = tokens.mapInArrow(_counter(positions, width), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(width, dtype=np.int64)
    counts[buckets.column("bucket").to_numpy()] = buckets.column("n").to_numpy()
    shared_counts = spark.sparkContext.broadcast(counts.clip(max=2**32 - 1).astype(np.uint32))
    noise = classes.rows * positions / width
    postings = cut(
        sigs.select("key", "sig", "grp_hash").mapInArrow(
            _poster(positions, width, shared_counts, noise, base, min(max_level, min_agree), verify_cost),
            "token long, key binary, level tinyint",
        ),
        "neardup-postings",
    )
    lists = postings.df.groupBy("token").agg(F.count(F.lit(1)).alias("len")).filter("len > 1")
    linked = cut(
        join_by_key(postings.df, lists.select("token", "len", F.ceil(F.col("len") / BLOCK).cast("int").alias("blocks")), "token", "len", postings.rows),
        "neardup-linked",
    )
    postings.drop()
    left = linked.df.select(
        "token", F.col("key").alias("key_a"), F.col("level").alias("level_a"), F.pmod(F.hash("key"), "blocks").alias("block")
    )
    right = linked.df.select(
        "token", F.col("key").alias("key_b"), F.col("level").alias("level_b"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block")
    )
    candidates = cut(
        left.join(right, ["token", "block"])
        .filter("key_a < key_b")
        .groupBy("key_a", "key_b")
        .agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("level_a", "level_b")).alias("need"))
        .filter("shared >= need")
        .select("key_a", "key_b"),
        "neardup-candidates",
    )
    linked.drop()
    # a class may have very many neighbours, so its signature is fetched by a join that splits hot keys
    side = sigs.select(F.col("key").alias("k"), F.struct("sig", "n").alias("r"))
    one = lookup(candidates.df, "key_a", side, candidates.rows).select("key_a", "key_b", F.col("r.sig").alias("sig_a"), F.col("r.n").alias("n_a"))
    if candidates.rows > hot_limit(candidates.rows):
        one = cut(one, "neardup-half").df  # the second join asks for its hot keys first
    both = lookup(one, "key_b", side, candidates.rows).select("key_a", "key_b", "sig_a", "n_a", F.col("r.sig").alias("sig_b"), F.col("r.n").alias("n_b"))
    pairs = (
        both.filter("sig_a is not null and sig_b is not null")
        .mapInArrow(_verifier(positions), "key_a binary, key_b binary, n_a long, n_b long, agree int")
        .filter((F.col("agree") >= min_agree) & (F.col("agree") < positions))
    )
    return rows, classes, pairs


def near_duplicate_pairs(
    records: DataFrame,
    *,
    positions: int = 128,
    min_agree: int = 96,
    max_level: int = MAX_LEVEL,
    verify_cost: float = VERIFY_COST,
) -> DataFrame:
    """All pairs (file_id_a, file_id_b, agree) with min_agree <= agree < positions, smaller id first.

    ``records``: id long, grp string, sig binary of 8 * positions bytes; other columns are ignored. Pairs never
    cross ``grp``. Rows with a null id, grp or sig, or a signature of another length, have no pairs. Repeated rows
    of one id count once; equal signatures in one grp are copies (agree = positions) and make no pair among
    themselves, but each of them pairs with every near duplicate of its class. An empty input gives no rows.

    The output is as large as the pairs are many; where copies abound, ``near_duplicate_links`` says the same in as many
    rows as there are classes and records.
    """
    rows, classes, pairs = _class_pairs(records, positions, min_agree, max_level, verify_cost)
    sigs = classes.df
    # members: a class above the limit is spread over SALTS parts; at most HOT_SHARE classes can be
    limit = hot_limit(classes.sums["rows"])
    hot = F.broadcast(sigs.filter(F.col("n") > limit).select("key", F.lit(True).alias("hot")))
    members = rows.select("key", "id").distinct().join(hot, "key", "left").select("key", "id", F.when(F.col("hot"), F.pmod(F.hash("id"), SALTS)).otherwise(0).alias("salt"))

    def salts(n: str):
        return F.explode(F.when(F.col(n) > limit, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))

    side = lambda s: members.select(F.col("key").alias(f"key_{s}"), F.col("id").alias(f"id_{s}"), F.col("salt").alias(f"salt_{s}"))
    found = (
        pairs.withColumn("salt_a", salts("n_a"))
        .join(side("a"), ["key_a", "salt_a"])
        .withColumn("salt_b", salts("n_b"))
        .join(side("b"), ["key_b", "salt_b"])
        .filter("id_a <> id_b")
    )
    return found.select(F.least("id_a", "id_b").alias("file_id_a"), F.greatest("id_a", "id_b").alias("file_id_b"), "agree")


def near_duplicate_links(
    records: DataFrame,
    *,
    positions: int = 128,
    min_agree: int = 96,
    max_level: int = MAX_LEVEL,
    verify_cost: float = VERIFY_COST,
) -> tuple[DataFrame, DataFrame]:
    """Links (class_a, class_b, agree, n_a, n_b) between classes of copies, and members (id, class_id) of all records
    that take part. A class is named by its lowest id and holds n records; class_a < class_b. Rows and cases are those of
    ``near_duplicate_pairs``."""
    rows, classes, pairs = _class_pairs(records, positions, min_agree, max_level, verify_cost)
    ids = rows.select("key", "id").distinct()
    named = cut(ids.groupBy("key").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n")), "neardup-names")
    known = named.df.select(F.col("key").alias("k"), F.struct("class_id", "n").alias("r"))
    found = cut(pairs.select("key_a", "key_b", "agree"), "neardup-pairs")
    one = lookup(found.df, "key_a", known, found.rows).withColumnRenamed("r", "a")
    if found.rows > hot_limit(found.rows):
        one = cut(one, "neardup-half").df
    two = lookup(one, "key_b", known, found.rows).withColumnRenamed("r", "b")
    low, high = F.least("a", "b"), F.greatest("a", "b")
    links = two.select(low["class_id"].alias("class_a"), high["class_id"].alias("class_b"), "agree", low["n"].alias("n_a"), high["n"].alias("n_b"))
    members = join_by_key(ids, named.df, "key", "n", classes.sums["rows"]).select("id", "class_id")
    return links, members


def latest_signatures(files: DataFrame, scans: DataFrame) -> DataFrame:
    """Rows (id, grp, sig) of each archive root's completed scan with the latest created_at; grp is the mime type
    in lower case, without parameters and surrounding blanks."""
    last = (
        scans.filter((F.col("phase") == "COMPLETE") & F.col("archive_root").isNotNull() & F.col("created_at").isNotNull())
        .groupBy("archive_root")
        .agg(F.max_by("id", F.struct("created_at", "id")).alias("scan_id"))
        .select("scan_id")
    )
    grp = F.lower(F.trim(F.split_part(F.col("mime_type"), F.lit(";"), F.lit(1))))
    return (
        files.filter(F.col("mime_type").isNotNull() & F.col("minhash_signature").isNotNull())
        .join(last, "scan_id", "left_semi")
        .select("id", grp.alias("grp"), F.col("minhash_signature").alias("sig"))
    )
