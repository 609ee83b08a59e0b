"""Exact groups, near-duplicate links and their clusters."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmill.functions.columns import clean_mime, near_dup_strategy
from siftmill.functions.fingerprints import PERMUTATIONS, minhash_similarity
from siftmill.operators.graph import components, lookup
from siftmill.shared import cut, hot_limit, join_by_key

#: One band of two equal values out of 64 is certain if more than 64 of 128 positions agree; for exactly 64, one in each
#: band, the four crossings of the first two bands are added.
BANDS, ROWS = 64, 2
MIN_SIZE_RATIO = 0.5
MIN_SIMILARITY = 0.5
MAX_CLUSTER = 100
AUTO_THRESHOLD = 0.95
#: Images alike in nine tenths of their 64 bits; at most so many bits may differ.
MIN_SIMILARITY_IMAGE, MOST_BITS = 0.9, 15
#: Strategies that scored pairs may name.
MAX_STRATEGIES = 50
#: A sketch holds three bits of each position in lanes of four, so many lanes to a long; spare lanes stay 0.
LANES, SKETCH = 15, 9
#: Members of one band value that meet within one block.
BLOCK = 1000


def keep_order() -> Column:
    """Order in which a file of a group is kept: oldest known modified_at, shortest path, lowest id."""
    return F.struct(F.col("modified_at").isNull(), "modified_at", F.length("path"), F.col("id"))


def size_groups(files: DataFrame, least: int = 2) -> DataFrame:
    """(size, n_files) of sizes shared by at least ``least`` files with content."""
    return files.filter("size > 0").groupBy("size").agg(F.count(F.lit(1)).alias("n_files")).filter(F.col("n_files") >= least)


def candidate_groups(files: DataFrame) -> DataFrame:
    """(scan_id, size, hash_partial, n_files, first_id) of files that share size and a known partial hash."""
    key = F.lower(F.trim("hash_partial"))
    return (
        files.filter("hash_partial is not null and size > 0")
        .groupBy("scan_id", "size", key.alias("hash_partial"))
        .agg(F.count(F.lit(1)).alias("n_files"), F.min("id").alias("first_id"))
        .filter("n_files >= 2")
    )


def exact_groups(files: DataFrame) -> DataFrame:
    """Groups of identical content of each scan: scan_id, size, hash_full, n_files, keep_id, keep_path, reclaimable_bytes.

    A group's key never gathers: counts and the file to keep are combined before the shuffle.
    """
    return (
        files.filter("hash_full is not null and size > 0")
        .groupBy("scan_id", "size", F.lower(F.trim("hash_full")).alias("hash_full"))
        .agg(F.count(F.lit(1)).alias("n_files"), F.min(F.struct(keep_order().alias("o"), "path")).alias("k"))
        .filter("n_files >= 2")
        .select("scan_id", "size", "hash_full", "n_files", F.col("k.o.id").alias("keep_id"), F.col("k.path").alias("keep_path"), ((F.col("n_files") - 1) * F.col("size")).alias("reclaimable_bytes"))
    )


def exact_links(files: DataFrame) -> DataFrame:
    """(id, class_id, n_links): each file with its class of identical content in its scan, named by the lowest id, and
    the number of pairs it is in. Pairs within a class are not listed one by one."""
    key = F.concat_ws("\x01", F.coalesce(F.col("scan_id").cast("string"), F.lit("")), F.col("size"), F.lower(F.trim("hash_full")))
    known = files.filter("hash_full is not null and size > 0").select("id", key.alias("key"))
    sizes = known.groupBy("key").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - 1).alias("n_links")).filter("n > 1")
    classes = cut(sizes, "exact-classes", {"rows": F.col("n")})
    return join_by_key(known, classes.df, "key", "n", classes.sums["rows"]).select("id", "class_id", "n_links")


def sketch(sig: Column) -> Column:
    """Three bits of each of the 128 numbers, as nine longs."""
    pack = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s * 16 + x.bitwiseAND(F.lit(7)))
    return F.array(*(pack(F.slice(sig, k * LANES + 1, LANES)) for k in range(SKETCH)))


def least_differing(a: Column, b: Column) -> Column:
    """Positions in which two sketches differ; the signatures differ there too, and maybe in more."""
    low, high = F.lit(int("7" * LANES, 16)), F.lit(int("8" * LANES, 16))
    parts = [F.bit_count((a[k].bitwiseXOR(b[k]) + low).bitwiseAND(high)) for k in range(SKETCH)]
    return sum(parts[1:], parts[0])


def _class_key() -> Column:
    return F.sha2(F.to_json(F.struct("kind", "size", "sig")), 256)


def near_duplicate_classes(records: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """Pairs (id_a, id_b, similarity, n_a, n_b) between classes of records alike in kind, size and signature.

    ``records``: id, kind, size, sig (array of 128 numbers). A class is named by its lowest id and holds n records.
    Pairs have one kind, a size ratio of at least one half (if both sizes are positive) and
    min_similarity <= similarity < 1. Found by 64 bands of two values and, where pairs of just 64 equal positions count,
    by the crossings of the first two bands; this is certain from 64 equal positions, the least that may be asked for.
    Sketches travel with the bands, so only pairs that can be similar enough fetch their signatures. Records of one id are
    taken to be alike.
    """
    if min_similarity < MIN_SIMILARITY:
        raise ValueError(f"pairs below a similarity of {MIN_SIMILARITY} are not found for certain")
    # fingerprints are written first, so that no aggregate holds them and none is computed twice
    kept = cut(records.filter("kind is not null").select("id", "kind", "size", "sig", _class_key().alias("key")), "near-signed")
    signed = kept.df.filter("sig is not null")
    names = signed.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    classes = cut(signed.drop("key").join(names.drop("key"), "id").dropDuplicates(["id"]), "near-classes").df
    at = [(k * ROWS + 1, k * ROWS + 2) for k in range(BANDS)]
    if PERMUTATIONS * min_similarity <= BANDS:
        at += [(a, b) for a in at[0] for b in at[1]]
    places = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(at)))
    band = F.explode(F.transform(places, lambda p: F.xxhash64("kind", p.k, F.element_at("sig", p.a), F.element_at("sig", p.b))))
    posts = classes.select("id", "size", sketch(F.col("sig")).alias("sketch"), band.alias("band"))
    lists = posts.groupBy("band").agg(F.count(F.lit(1)).alias("len")).filter("len > 1")
    blocks = lists.select("band", "len", F.ceil(F.col("len") / BLOCK).cast("int").alias("blocks"))
    linked = cut(join_by_key(posts, blocks, "band", "len", kept.rows * len(at)).select("band", "id", "size", "sketch", "blocks"), "near-posts").df
    left = linked.select("band", F.col("id").alias("id_a"), F.col("size").alias("size_a"), F.col("sketch").alias("sketch_a"), F.pmod(F.hash("id"), "blocks").alias("block"))
    right = linked.select("band", F.col("id").alias("id_b"), F.col("size").alias("size_b"), F.col("sketch").alias("sketch_b"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    near = (2 * F.least("size_a", "size_b") >= F.greatest("size_a", "size_b")) | (F.least("size_a", "size_b") <= 0)
    alike = least_differing(F.col("sketch_a"), F.col("sketch_b")) <= PERMUTATIONS * (1 - min_similarity)
    candidates = left.join(right, ["band", "block"]).filter(F.col("id_a") < F.col("id_b")).filter(near & alike).select("id_a", "id_b").distinct()
    side = lambda s: classes.select(F.col("id").alias(f"id_{s}"), F.col("sig").alias(f"sig_{s}"), F.col("n").alias(f"n_{s}"), F.col("kind").alias(f"kind_{s}"))
    pairs = candidates.join(side("a"), "id_a").join(side("b"), "id_b").filter("kind_a = kind_b")
    scored = pairs.withColumn("similarity", minhash_similarity(F.col("sig_a"), F.col("sig_b")))
    return scored.filter((F.col("similarity") >= min_similarity) & (F.col("similarity") < 1.0)).select("id_a", "id_b", "similarity", "n_a", "n_b")


def near_duplicate_members(records: DataFrame) -> DataFrame:
    """(id, class_id, n): every record that has a kind and a signature with its class of ``near_duplicate_classes``, named
    by the lowest id, and the number of records in it. A class of many copies does not gather in one task."""
    known = records.filter("kind is not null").select("id", "sig", _class_key().alias("key"))
    keyed = cut(known.select("id", "key", F.col("sig").isNotNull().alias("signed")), "near-keys")
    signed = keyed.df.filter("signed").drop("signed")
    classes = signed.groupBy("key").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n")).withColumn("weight", F.col("n"))
    return join_by_key(signed, classes, "key", "weight", keyed.rows).select("id", "class_id", "n")


def scored_links(pairs: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """Usable near-duplicate pairs (a, b, similarity), each once with its highest similarity; 1.0 is none of them."""
    ok = pairs.filter(F.col("similarity").between(min_similarity, 1.0) & (F.col("similarity") < 1.0) & (F.col("file_id_a") != F.col("file_id_b")))
    return ok.groupBy(F.least("file_id_a", "file_id_b").alias("a"), F.greatest("file_id_a", "file_id_b").alias("b")).agg(F.max("similarity").alias("similarity"))


def near_duplicate_clusters(
    pairs: DataFrame, files: DataFrame, threshold: float = AUTO_THRESHOLD, max_members: int = MAX_CLUSTER, oversize: bool = False, min_similarity: float = MIN_SIMILARITY
) -> DataFrame:
    """Clusters (group_id, strategy, canonical_file_id, n_members, confidence, queue) of scored near-duplicate pairs.

    See ``near_duplicate_groups``; the strategy is that of the kept file's media type.
    """
    groups = near_duplicate_groups(scored_links(pairs, min_similarity), files, threshold, max_members, oversize)[0]
    return groups.select("group_id", near_dup_strategy(F.col("mime")).alias("strategy"), "canonical_file_id", "n_members", "confidence", "queue")


def near_duplicate_groups(links: DataFrame, files: DataFrame, threshold: float = AUTO_THRESHOLD, max_members: int = MAX_CLUSTER, oversize: bool = False) -> tuple[DataFrame, DataFrame]:
    """Groups (group_id, mime, canonical_file_id, n_members, confidence, queue) and members (group_id, file_id) of links
    (a, b, similarity), each pair once.

    Components of the links, ids without a file linking but not counting; the file to keep by ``keep_order``; members whose
    size is below half or above twice the kept one's are dropped, then, farthest by log size first, those that spread the
    sizes beyond a ratio of two; clusters of one or of more than ``max_members`` members are dropped, with ``oversize`` the
    latter are kept in a queue of that name; confidence is the least similarity between two members left, 0 if none; from
    ``threshold`` on a cluster is queued as auto, else review. group_id is its lowest id before dropping. Clusters of any
    size are spread over all tasks.
    """
    links = cut(links, "scored-links")
    placed = components(links.df.select("a", "b"))
    info = files.select(F.col("id").alias("v"), "size", "modified_at", "path", clean_mime(F.col("mime_type")).alias("mime_type"))
    nodes = cut(placed.join(info, "v").withColumnRenamed("v", "id"), "cluster-nodes")
    heads = nodes.df.groupBy("root").agg(F.min(F.struct(keep_order().alias("o"), "size", "mime_type")).alias("k")).select(
        F.col("root").alias("k"), F.struct(F.col("k.o.id").alias("canonical"), F.col("k.size").alias("csize"), F.col("k.mime_type").alias("cmime")).alias("r")
    )
    near = lookup(nodes.df.select("root", "id", "size"), "root", heads, nodes.rows).select("root", "id", "size", "r.*")
    near = cut(near.filter(
        (F.col("id") == F.col("canonical")) | (F.col("csize") <= 0) | ((F.col("size") > 0) & (2 * F.least("size", "csize") >= F.greatest("size", "csize")))
    ), "cluster-near")
    # members sorted by distance from the kept one; those up to the first that spreads the sizes too far stay. Sizes of
    # one cluster lie within a factor of four here, and equal sizes share a fate, so the window runs over sizes and says
    # for each cluster how far it reaches.
    far = F.abs(F.ln(F.greatest("size", F.lit(1))) - F.ln(F.greatest("csize", F.lit(1))))
    sizes = near.df.groupBy("root", "csize", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("far", far)
    run = Window.partitionBy("root").orderBy("far", "size").rowsBetween(Window.unboundedPreceding, 0)
    fits = sizes.withColumn("fits", (F.col("csize") <= 0) | (2 * F.min("size").over(run) >= F.max("size").over(run)))
    reach = fits.filter("fits").groupBy(F.col("root").alias("k")).agg(F.max(F.struct("far", "size")).alias("r"))
    inside = lookup(near.df.withColumn("far", far), "root", reach, near.rows).filter(F.struct("far", "size") <= F.col("r"))
    members = cut(inside.select("root", "id", "canonical", "cmime"), "cluster-members")
    counts = members.df.groupBy("root").agg(F.count(F.lit(1)).alias("n_members"), F.first("canonical").alias("canonical_file_id"), F.first("cmime").alias("mime"))
    large = F.col("n_members") > max_members
    kept = counts.filter((F.col("n_members") >= 2) & (F.lit(oversize) | ~large))
    of = members.df.select(F.col("id").alias("k"), F.col("root").alias("r"))
    ends = lookup(links.df, "a", of, links.rows).filter("r is not null").withColumnRenamed("r", "root")
    if links.rows > hot_limit(links.rows):
        ends = cut(ends, "cluster-ends").df
    ends = lookup(ends, "b", of, links.rows).filter("r = root")
    least = ends.groupBy("root").agg(F.min("similarity").alias("least"))
    confidence = F.coalesce("least", F.lit(0.0))
    groups = cut(
        kept.join(least, "root", "left").select(
            F.col("root").alias("group_id"), "mime", "canonical_file_id", "n_members", confidence.alias("confidence"),
            F.when(large, "oversize").when(confidence >= threshold, "auto").otherwise("review").alias("queue"),
        ),
        "cluster-groups",
    ).df
    names = groups.select(F.col("group_id").alias("k"), F.lit(True).alias("r"))
    return groups, lookup(members.df, "root", names, members.rows).filter("r").select(F.col("root").alias("group_id"), F.col("id").alias("file_id"))


def exact_duplicate_groups(pairs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (group_id, canonical_file_id, n_members, confidence) and members (group_id, file_id) of exact pairs
    (file_id_a, file_id_b): components, without the pruning by size or number that near duplicates undergo."""
    links = pairs.filter("file_id_a <> file_id_b").select(F.least("file_id_a", "file_id_b").alias("a"), F.greatest("file_id_a", "file_id_b").alias("b"))
    info = files.select(F.col("id").alias("v"), "size", "modified_at", "path")
    nodes = cut(components(links).join(info, "v").withColumnRenamed("v", "id"), "exact-nodes")
    counts = nodes.df.groupBy(F.col("root").alias("group_id")).agg(F.min(keep_order()).alias("k"), F.count(F.lit(1)).alias("n_members")).filter("n_members >= 2")
    groups = cut(counts.select("group_id", F.col("k.id").alias("canonical_file_id"), "n_members", F.lit(1.0).alias("confidence")), "exact-groups").df
    names = groups.select(F.col("group_id").alias("k"), F.lit(True).alias("r"))
    return groups, lookup(nodes.df, "root", names, nodes.rows).filter("r").select(F.col("root").alias("group_id"), F.col("id").alias("file_id"))


def clusters_by_strategy(pairs: DataFrame, files: DataFrame, threshold: float = AUTO_THRESHOLD, max_members: int = MAX_CLUSTER) -> tuple[DataFrame, DataFrame]:
    """Groups (strategy, group_id, canonical_file_id, n_members, confidence) and members (strategy, group_id, file_id) of
    scored pairs (file_id_a, file_id_b, similarity, strategy).

    Exact pairs (strategy 'exact-hash', of any similarity) and near-duplicate pairs of each other strategy are clustered
    apart, so a file may be in one group of each. The strategy of a group is that of its pairs, 'unknown' for null.
    """
    named = pairs.withColumn("strategy", F.coalesce(F.lower(F.trim("strategy")), F.lit("unknown")))
    groups, members = exact_duplicate_groups(named.filter(F.col("strategy") == "exact-hash"), files)
    out = groups.select(F.lit("exact-hash").alias("strategy"), "group_id", "canonical_file_id", "n_members", "confidence")
    listed = members.select(F.lit("exact-hash").alias("strategy"), "group_id", "file_id")
    near = cut(named.filter(F.col("strategy") != "exact-hash"), "near-pairs").df
    for (strategy,) in near.select("strategy").distinct().limit(MAX_STRATEGIES + 1).collect():
        g, m = near_duplicate_groups(scored_links(near.filter(F.col("strategy") == strategy)), files, threshold, max_members)
        out = out.unionByName(g.select(F.lit(strategy).alias("strategy"), "group_id", "canonical_file_id", "n_members", "confidence"))
        listed = listed.unionByName(m.select(F.lit(strategy).alias("strategy"), "group_id", "file_id"))
    return out, listed


def image_links(images: DataFrame, min_similarity: float = MIN_SIMILARITY_IMAGE) -> DataFrame:
    """Pairs (id_a, id_b, similarity, n_a, n_b) between classes of images alike in kind and fingerprint.

    ``images``: id, kind (a clean media type), fp (8 bytes). A class is named by its lowest id and holds n images. Pairs
    are of one kind and min_similarity <= similarity < 1, similarity being the share of equal bits. Of four parts of 16
    bits one at least differs in no more than a quarter of the bits that may differ, so each image looks up the parts
    within that distance of its own; parts met often are joined in blocks. At most 15 bits may differ, since from about
    there on most images would be alike.
    """
    most = int(64 * (1 - min_similarity) + 1e-9)
    if not 0 < most <= MOST_BITS:
        raise ValueError(f"between 1 and {MOST_BITS} of 64 bits may differ")
    number = F.conv(F.hex("fp"), 16, -10).cast("decimal(20,0)").cast("long")
    classes = cut(
        images.filter((F.octet_length("fp") == 8) & F.col("kind").isNotNull()).groupBy("kind", number.alias("bits")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "image-classes"
    )
    part = lambda k: F.shiftrightunsigned("bits", 16 * k).bitwiseAND(F.lit(0xFFFF))
    key = lambda k, v: F.xxhash64("kind", F.lit(k), v)
    posts = classes.df.select("id", "kind", "bits", "n", F.explode(F.array(*(key(k, part(k)) for k in range(4)))).alias("part"))
    lists = posts.groupBy("part").agg(F.count(F.lit(1)).alias("len"))
    blocks = lists.select("part", "len", F.ceil(F.col("len") / BLOCK).cast("int").alias("blocks"))
    masks = F.array(*(F.lit(sum(1 << b for b in bits)).cast("long") for r in range(most // 4 + 1) for bits in combinations(range(16), r)))
    around = lambda k: F.transform(masks, lambda m: key(k, part(k).bitwiseXOR(m)))
    asked = F.explode(F.concat(*(around(k) for k in range(4))))
    probes = classes.df.select("id", "kind", "bits", "n", asked.alias("part"))
    side = lambda df, s: df.select("part", "block", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "kind", "bits", "n")))
    posted = join_by_key(posts, blocks, "part", "len", classes.rows * 4).withColumn("block", F.pmod(F.hash("id"), "blocks"))
    asking = join_by_key(probes, blocks, "part", "len", classes.rows * 4).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    differ = F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b")))
    met = side(posted, "a").join(side(asking, "b"), ["part", "block"]).filter((F.col("id_a") < F.col("id_b")) & (F.col("kind_a") == F.col("kind_b")) & (differ <= most))
    return met.select("id_a", "id_b", (1 - differ / F.lit(64.0)).alias("similarity"), "n_a", "n_b").distinct()
