"""One surviving record for each duplicate group, its fields filled from all members by token-level consensus.

The survivor is the member first in a fixed order (see ``surviving_files``). Field values are voted on, each member
with the weight of its provider's trust and its completeness. Paths are voted on token by token: the group's distinct
paths are aligned progressively, heaviest first, into columns; each column elects a token or a gap; the existing path
with the fewest token edits to the elected sequence is emitted. Groups with more distinct paths than ``BLOCK`` are
aligned in blocks, whose consensus sequences are aligned again until one backbone is left; then all paths of the group
are aligned with that backbone in parallel and their votes are summed, so no task ever holds a large group.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmill.operators.graph import lookup
from siftmill.shared import cut, hot_limit, join_by_key

#: Distinct paths that are aligned in one place.
BLOCK = 256
#: Most member ids that are broadcast to sift the files by (about 70 bytes each) before any of them is shuffled.
SIFT_IDS = 1_000_000
#: Timestamps before this are senseless.
FIRST_SENSIBLE = "1990-01-01 00:00:00"
#: Fields voted on as a whole; their cleaned text stands for them.
VOTED = ("provider", "size", "modified_at", "mime_type", "hash_partial", "hash_full", "copy_hint")

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[\W_]")
GAP = ""
_GAP_COST, _MISS = -0.6, -1.0


def tokenize(value: str) -> list[str]:
    return _TOKEN.findall(value)


def _path(columns: list[dict[str, float]], total: float, tokens: list[str]) -> list[tuple[int, int]]:
    """Best global alignment of tokens with columns: pairs (column or -1, token or -1) in order.

    A token scores twice its share of the column it joins. Ends on which both agree are not searched.
    """
    n, m, lead = len(columns), len(tokens), 0
    top = [max(c, key=lambda t: (c[t], t)) for c in columns]
    while lead < n and lead < m and top[lead] == tokens[lead]:
        lead += 1
    tail = 0
    while tail < n - lead and tail < m - lead and top[n - 1 - tail] == tokens[m - 1 - tail]:
        tail += 1
    a, b = columns[lead : n - tail], tokens[lead : m - tail]
    # rows of the best score and of the step taken: 0 both, 1 column against a gap, 2 token of its own
    prev = [j * _GAP_COST for j in range(len(b) + 1)]
    steps = [[2] * (len(b) + 1)]
    for i, col in enumerate(a, 1):
        row, step = [i * _GAP_COST], [1]
        for j, tok in enumerate(b, 1):
            w = col.get(tok)
            both = prev[j - 1] + (2 * w / total if w else _MISS)
            up, own = prev[j] + _GAP_COST, row[j - 1] + _GAP_COST
            if both >= up and both >= own:
                row.append(both)
                step.append(0)
            elif up >= own:
                row.append(up)
                step.append(1)
            else:
                row.append(own)
                step.append(2)
        prev = row
        steps.append(step)
    i, j, middle = len(a), len(b), []
    while i or j:
        s = steps[i][j] if i and j else (1 if i else 2)
        middle.append((lead + i - 1 if s != 2 else -1, lead + j - 1 if s != 1 else -1))
        i, j = i - (s != 2), j - (s != 1)
    ends = [(n - tail + k, m - tail + k) for k in range(tail)]
    return [(k, k) for k in range(lead)] + middle[::-1] + ends


def align(values: list[tuple[list[str], float]]) -> list[dict[str, float]]:
    """Columns (token -> weight, GAP included) of the progressive alignment, heaviest value first."""
    order = sorted(values, key=lambda v: (-v[1], v[0]))
    if not order:
        return []
    columns = [{t: order[0][1]} for t in order[0][0]]
    total = order[0][1]
    for tokens, w in order[1:]:
        merged = []
        for c, t in _path(columns, total, tokens):
            col = columns[c] if c >= 0 else {GAP: total}
            tok = tokens[t] if t >= 0 else GAP
            col[tok] = col.get(tok, 0.0) + w
            merged.append(col)
        columns, total = merged, total + w
    return columns


def elect(columns: list[dict[str, float]]) -> list[str]:
    """The heaviest token of each column, the smaller of two alike; columns that elect a gap are left out."""
    won = (min(c, key=lambda t: (-round(c[t], 9), t)) for c in columns)
    return [t for t in won if t != GAP]


def edits(a: list[str], b: list[str]) -> int:
    """Token edit distance."""
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b)
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = row
    return prev[-1]


def closest(values: list[tuple[str, float]], consensus: list[str]) -> str:
    return min(values, key=lambda v: (edits(tokenize(v[0]), consensus), -round(v[1], 9), len(v[0]), v[0]))[0]


def consensus_value(values: list[tuple[str, float]]) -> str | None:
    """The existing value closest to the token consensus of (value, weight); None for no values."""
    if len(values) < 3:  # the heavier of two is its own consensus
        return min(values, key=lambda v: (-round(v[1], 9), len(v[0]), v[0]))[0] if values else None
    return closest(values, elect(align([(tokenize(v), w) for v, w in values])))


# ---------------------------------------------------------------- distributed forms


def _pairs(batch: pa.RecordBatch) -> Iterator[list[tuple[str, float]]]:
    for x in batch.column("vals").to_pylist():
        yield [(v["value"], v["w"]) for v in x]


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([consensus_value(v) for v in _pairs(batch)], pa.string())], ["key", "value"])


def _backbones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consensus sequences of blocks, as token lists joined by NUL, with the block's weight."""
    for batch in batches:
        seqs, weights = [], []
        for vals in _pairs(batch):
            seqs.append("\0".join(elect(align([(v.split("\0"), w) for v, w in vals]))))
            weights.append(sum(w for _, w in vals))
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array(seqs, pa.string()), pa.array(weights, pa.float64())], ["key", "value", "w"]
        )


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes (key, column, slot, token, w) of each value aligned with its group's backbone; tokens between two columns
    vote in slots of their own after the column on their left."""
    for batch in batches:
        out: list[tuple] = []
        for key, value, w, bone in zip(*(batch.column(c).to_pylist() for c in ("key", "value", "w", "bone"))):
            columns, tokens = [{t: 1.0} for t in bone.split("\0")], tokenize(value)
            at, slot = -1, 0
            for c, t in _path(columns, 1.0, tokens):
                if c >= 0:
                    at, slot = c, 0
                else:
                    slot += 1
                out.append((key, at, slot, tokens[t] if t >= 0 else GAP, w))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64()))],
            ["key", "col", "slot", "token", "w"],
        )


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d = [edits(tokenize(v), c or []) for v, c in zip(batch.column("value").to_pylist(), batch.column("consensus").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("value"), batch.column("w"), pa.array(d, pa.int64())], ["key", "value", "w", "d"])


def token_consensus(values: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, value): for each key the existing value closest to the weighted token consensus of its values.

    ``values``: key long, value string, w double > 0. Null values have no vote; equal values pool their weights.
    """
    votes = cut(values.filter("value is not null").groupBy("key", "value").agg(F.sum("w").alias("w")), "consensus-values")
    sizes = votes.df.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("total"))
    marked = cut(sizes, "consensus-sizes", {"large": (F.col("n") > block).cast("int")})
    gather = F.collect_list(F.struct("value", "w")).alias("vals")
    if not marked.sums["large"]:
        return votes.df.groupBy("key").agg(gather).mapInArrow(_small, "key long, value string")
    large = marked.df.filter(F.col("n") > block)
    few = join_by_key(votes.df, marked.df.filter(F.col("n") <= block).select("key", "n"), "key", "n", votes.rows)
    small = few.groupBy("key").agg(gather).mapInArrow(_small, "key long, value string")
    many = cut(join_by_key(votes.df, large.select("key", "n", F.col("n").alias("of")), "key", "n", votes.rows), "consensus-large").df
    # values as token lists from here on; blocks are of equal expected size
    split = F.regexp_replace("value", r"([^\p{L}\p{N}]|_)", "\0$1\0")
    split = F.regexp_replace(split, r"(?<=\p{N})(?=\p{L})|(?<=\p{L})(?=\p{N})", "\0")
    level = many.select("key", F.trim(F.lit("\0"), F.regexp_replace(split, "\0+", "\0")).alias("value"), "w", "of")
    while True:
        parts = F.greatest(F.ceil(F.col("of") / block), F.lit(1)).cast("int")
        blocks = level.withColumn("part", F.pmod(F.xxhash64("value", "w"), parts)).groupBy("key", "part").agg(gather)
        done = cut(blocks.mapInArrow(_backbones, "key long, value string, w double"), "consensus-bones")
        counts = done.df.groupBy("key").agg(F.count(F.lit(1)).alias("of"))
        if not counts.filter("of > 1").limit(1).count():
            break
        level = done.df.join(counts, "key")
    bones = done.df.select("key", F.col("value").alias("bone")).join(large.select("key", "n", "total"), "key")
    bone_of = join_by_key(many.select("key", "value", "w"), bones.select("key", "n", "bone"), "key", "n", votes.rows)
    polled = bone_of.mapInArrow(_votes, "key long, col int, slot int, token string, w double")
    tally = polled.groupBy("key", "col", "slot", "token").agg(F.sum("w").alias("w"))
    # an inserted token competes with the weight of all values that have none there
    won = tally.groupBy("key", "col", "slot").agg(F.min(F.struct(-F.col("w"), "token")).alias("best"), F.sum("w").alias("cast"))
    kept = won.join(bones.select("key", "total"), "key").filter("best.token <> '' and -best.col1 >= total - cast")
    consensus = kept.groupBy("key").agg(F.expr("transform(sort_array(collect_list(struct(col, slot, best.token))), x -> x.token)").alias("consensus"))
    measured = join_by_key(many.select("key", "value", "w"), large.select("key", "n").join(consensus, "key", "left"), "key", "n", votes.rows)
    ranked = measured.mapInArrow(_distances, "key long, value string, w double, d long")
    best = ranked.groupBy("key").agg(F.min(F.struct("d", -F.round("w", 9), F.length("value"), "value")).alias("b"))
    return small.unionByName(best.select("key", F.col("b.value").alias("value")))


def group_members(groups: DataFrame, members: DataFrame, files: DataFrame, scans: DataFrame, providers: DataFrame) -> DataFrame:
    """One row for each distinct existing member of each group, with its file's fields, cleaned, and its vote weight.

    Groups and files that hold very many member rows are joined by broadcast of those few keys.
    """
    run = scans.filter("id is not null").groupBy(F.col("id").alias("scan_id")).agg(F.max("created_at").alias("run_at"))
    g = groups.filter("id is not null").groupBy(F.col("id").alias("group_id")).agg(F.max("scan_id").alias("scan_id")).join(run, "scan_id", "left")
    m = cut(members.select(F.col("group_id").cast("long").alias("group_id"), F.col("file_id").cast("long").alias("file_id")).na.drop().distinct(), "representatives-ids")
    rank = providers.select(F.lower(F.trim("provider")).alias("provider"), F.col("trust_rank").cast("long").alias("trust_rank")).na.drop()
    rank = rank.groupBy("provider").agg(F.min("trust_rank").alias("trust_rank"))
    clean = files.select(
        F.col("id").cast("long").alias("file_id"),
        "path",
        F.lower(F.trim("provider")).alias("provider"),
        F.col("size").cast("long").alias("size"),
        "modified_at",
        F.lower(F.trim(F.split_part("mime_type", F.lit(";"), F.lit(1)))).alias("mime_type"),
        F.lower(F.trim("hash_partial")).alias("hash_partial"),
        F.lower(F.trim("hash_full")).alias("hash_full"),
        "copy_hint",
    )
    clean = clean.filter("file_id is not null")
    if m.rows <= SIFT_IDS:
        clean = clean.join(F.broadcast(m.df.select("file_id").distinct()), "file_id", "left_semi")
    placed = lookup(m.df, "group_id", g.select(F.col("group_id").alias("k"), F.struct("run_at").alias("r")), m.rows).filter("r is not null").select("group_id", "file_id", "r.run_at")
    if m.rows > hot_limit(m.rows):
        placed = cut(placed, "representatives-placed").df  # the next join asks for its hot keys first
    fields_of = clean.select(F.col("file_id").alias("k"), F.struct(*(c for c in clean.columns if c != "file_id")).alias("r"))
    rows = lookup(placed, "file_id", fields_of, m.rows).filter("r is not null").select("group_id", "file_id", "run_at", "r.*").join(rank, "provider", "left")
    sensible = (F.col("modified_at") >= F.lit(FIRST_SENSIBLE).cast("timestamp_ntz")) & (F.col("run_at").isNull() | (F.col("modified_at") <= F.col("run_at")))
    fields = ("path", *VOTED)
    full = sum(F.col(c).isNotNull().cast("int") for c in fields) / float(len(fields))
    weight = (0.5 + 0.5 * full) / F.coalesce(F.greatest("trust_rank", F.lit(1)), F.lit(100)).cast("double")
    return (
        rows.withColumn("modified_at", F.when(sensible, F.col("modified_at")))
        .withColumn("w", weight)
        .groupBy("group_id", "file_id")  # a file id written twice is one member
        .agg(F.min(F.struct("trust_rank", *fields, "w")).alias("f"))
        .select("group_id", "file_id", "f.*")
    )


def surviving_files(member_rows: DataFrame) -> DataFrame:
    """(group_id, file_id, members): the member that comes first by sensible modified_at (oldest first, unknown last),
    trust rank (unlisted last), characters of path (null last), id; groups of fewer than two members have none."""
    last = F.lit(2**62)
    order = F.struct(
        F.col("modified_at").isNull(), "modified_at", F.coalesce("trust_rank", last), F.coalesce(F.length("path").cast("long"), last), "file_id"
    )
    first = member_rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("members"), F.min(order).alias("o"))
    return first.filter("members >= 2").select("group_id", F.col("o.file_id").alias("file_id"), "members")


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def best_representatives(groups: DataFrame, members: DataFrame, files: DataFrame, scans: DataFrame, providers: DataFrame, block: int = BLOCK) -> DataFrame:
    """(group_id, file_id, members, path, provider, size, modified_at, mime_type, hash_partial, hash_full, copy_hint).

    file_id is the survivor of ``surviving_files``; the other fields are the group's elected values, null where no
    member has one. Ties in a vote go to the smaller text, in a path vote to the heavier, then shorter, then smaller
    path. Members without a file, groups not in ``groups`` and null ids take no part; repeated rows count once.
    """
    rows = cut(group_members(groups, members, files, scans, providers), "representatives-members")
    first = surviving_files(rows.df)
    ballots = rows.df.select(
        "group_id", "w", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), _text(c).alias("value")) for c in VOTED))).alias("b")
    ).filter("b.value is not null")
    tally = ballots.groupBy("group_id", "b.field", "b.value").agg(F.sum("w").alias("w"))
    won = tally.groupBy("group_id").agg(
        *(F.min(F.when(F.col("field") == c, F.struct(-F.round("w", 9), F.col("value")))).alias(c) for c in VOTED)
    )
    types = {"size": "long", "modified_at": "timestamp_ntz"}
    elected = won.select("group_id", *(F.col(c)["value"].cast(types.get(c, "string")).alias(c) for c in VOTED))
    paths = token_consensus(rows.df.select(F.col("group_id").alias("key"), F.col("path").alias("value"), "w"), block)
    return (
        first.join(elected, "group_id", "left")
        .join(paths.select(F.col("key").alias("group_id"), F.col("value").alias("path")), "group_id", "left")
        .select("group_id", "file_id", "members", "path", *VOTED)
    )
