"""Mixing sources to target weights: certain whole copies, then Pareto order sampling of the remainder.

Each source gets a target number of tokens. A document of weight w is due m = min(max_repeats, c * w) copies, c such
that the source's due tokens are its target. Its floor(m) copies are certain. The rest pi = m - floor(m) is an
inclusion probability: documents are ranked by random odds over inclusion odds, u / (1 - u) / (pi / (1 - pi)), and the
lowest ranks are taken as long as the source's remaining tokens are not exceeded; one document that fits what is then
missing best takes the last place. The sample so has a fixed size in tokens at unequal probabilities.
"""

from __future__ import annotations

import base64
import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmill.shared import cut, spread

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the byte-level BPE vocabularies.
BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ranks are summed by so many bins a source before the bin with the cut is sorted.
RANK_BINS = 4096
#: Steps of a document's weight are 2^(1/8), from 2^-16 to 2^16: at most 257 steps a source reach the driver.
WEIGHT_STEPS, WEIGHT_SPAN = 8, 16
#: Most sources a table of weights may name; it is a setting, not data.
MAX_SOURCES = 10_000

_encoders: dict[str, object] = {}


def _encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _encoders[path] = tiktoken.Encoding("bpe", pat_str=BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def _token_counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), batch.column("draw"), pa.array(n, pa.int64())], ["doc_id", "source", "draw", "n_tokens"]
            )

    return run


def source_key(c: Column) -> Column:
    """One spelling of a source: lower case, blanks and hyphens inside as one underscore, none around."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-_]+", "_")


def count_tokens(documents: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, seed: int = 0) -> DataFrame:
    """(doc_id, source, draw, n_tokens) of whole texts; draw is a reproducible uniform number in (0, 1)."""
    bits = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).bitwiseAND(F.lit((1 << 52) - 1))
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        source_key(F.col("source").cast("string")).alias("source"),
        ((bits.cast("double") + 0.5) / float(1 << 52)).alias("draw"),
        F.col("text").cast("string").alias("text"),
    )
    return spread(docs).mapInArrow(_token_counter(tokenizer), "doc_id long, source string, draw double, n_tokens long")


def allocate(capacity: dict[str, float], weight: dict[str, float], total: float | None) -> dict[str, float]:
    """Tokens for each source, in proportion to its weight, up to its capacity.

    Without ``total`` it is the largest at which no source that has anything falls short of its weight. With one that
    is larger, sources at their capacity stay there and the others share the rest by their weights.
    """
    live = {s for s, w in weight.items() if w > 0 and capacity.get(s, 0) > 0}
    if not live:
        return {}
    if total is None:
        rate = min(capacity[s] / weight[s] for s in live)
        return {s: min(capacity[s], rate * weight[s]) for s in live}
    out: dict[str, float] = {}
    rest = min(total, sum(capacity[s] for s in live))
    for s in sorted(live, key=lambda s: capacity[s] / weight[s]):
        open_weight = sum(weight[x] for x in live if x not in out)
        out[s] = min(capacity[s], rest * weight[s] / open_weight)
        rest -= out[s]
    return out


def solve_rate(bins: list[tuple[float, float]], repeats: float, target: float) -> float:
    """c with sum(tokens * min(repeats, c * weight)) = target over (weight, tokens)."""
    left = target
    open_mass = sum(w * t for w, t in bins)
    for w, t in sorted(bins, reverse=True):  # the heaviest reach the cap first
        c = left / open_mass if open_mass > 0 else 0.0
        if c * w <= repeats:
            return c
        left -= repeats * t
        open_mass -= w * t
    return math.inf


def mix_sources(
    documents: DataFrame,
    weights: DataFrame,
    *,
    total_tokens: float | str | None = None,
    weight: Column | None = None,
    tokenizer: str = DEFAULT_TOKENIZER,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Chosen documents (doc_id, source, n_tokens, copies >= 1) and shares, one row for each source.

    ``weights``: source, target_weight, max_repeats. Weights are taken relative to their sum; null, negative and NaN
    weights count as 0, null max_repeats as 1, a source named twice counts with the sum of its weights and the least
    of its max_repeats. ``weight`` (an expression over n_tokens, source) makes documents of one source more or less
    likely; without it they are alike. Sources without documents, and documents of sources without a weight, with a
    null source or without tokens, take no part; the former are reported with what they missed. Rows alike in
    doc_id, source and text are one document. Empty tables give no documents.

    ``total_tokens`` is the size of the mix, 'available' for as many tokens as the weighted sources have; without it the
    mix is as large as it can be with no source short of its weight.

    Shares: source, target_share, actual_share, target_tokens, actual_tokens, available_tokens, documents_used,
    max_copies, at_cap (whether max_repeats binds the source).
    """
    spark = documents.sparkSession
    named = (
        weights.select(source_key(F.col("source")).alias("source"), F.col("target_weight").cast("double").alias("w"), F.col("max_repeats").cast("long").alias("r"))
        .filter("source is not null")
        .groupBy("source")
        .agg(F.sum(F.when((F.col("w") > 0) & ~F.isnan("w"), F.col("w")).otherwise(0.0)).alias("w"), F.min(F.greatest(F.coalesce("r", F.lit(1)), F.lit(0))).alias("r"))
        .limit(MAX_SOURCES + 1)
        .collect()
    )
    if len(named) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources in the table of weights")
    share = {x.source: x.w / (sum(y.w for y in named) or 1.0) for x in named}
    repeats = {x.source: x.r for x in named}
    setting = F.broadcast(spark.createDataFrame([(x.source,) for x in named], "source string"))
    raw = F.coalesce(weight.cast("double"), F.lit(1.0)) if weight is not None else F.lit(1.0)
    step = F.round(F.log2(F.greatest(raw, F.lit(2.0**-WEIGHT_SPAN))) * WEIGHT_STEPS)
    bounded = F.least(F.greatest(step, F.lit(-float(WEIGHT_SPAN * WEIGHT_STEPS))), F.lit(float(WEIGHT_SPAN * WEIGHT_STEPS))).cast("int")
    docs = cut(
        count_tokens(documents, tokenizer, seed).join(setting, "source", "left_semi").filter("n_tokens > 0")
        .dropDuplicates(["source", "doc_id", "draw"])
        .withColumn("step", bounded),
        "mix-tokens",
    ).df
    have: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for source, k, tokens in docs.groupBy("source", "step").agg(F.sum("n_tokens")).collect():
        have[source].append((k, tokens))
    available = {s: sum(t for _, t in x) for s, x in have.items()}
    if total_tokens == "available":
        total_tokens = float(sum(t for s, t in available.items() if share.get(s, 0) > 0))
    capacity = {s: available[s] * repeats[s] for s in have}
    target = allocate(capacity, share, total_tokens)
    plan, left = [], {}
    for s, goal in target.items():
        left[s] = goal
        c = solve_rate([(2.0 ** (k / WEIGHT_STEPS), t) for k, t in have[s]], repeats[s], goal)
        for k, t in have[s]:
            due = min(float(repeats[s]), c * 2.0 ** (k / WEIGHT_STEPS))
            whole = math.floor(due + 1e-9)
            plan.append((s, k, whole, max(0.0, due - whole)))
            left[s] -= whole * float(t)
    # at most 257 steps for each of the bounded number of sources
    steps = spark.createDataFrame([(s, k, w, p, left[s]) for s, k, w, p in plan], "source string, step int, whole long, pi double, need double")
    due = docs.join(F.broadcast(steps), ["source", "step"]).withColumn(
        "rank", F.expr("case when pi > 0 then (draw / (1 - draw)) / (pi / (1 - pi)) end")
    )
    # x in (0, 1) keeps the order of the ranks and splits it into bins of bounded number
    due = due.withColumn("x", F.expr("rank / (1 + rank)")).withColumn("bin", F.floor(F.col("x") * RANK_BINS).cast("int"))
    binned = due.filter("pi > 0").groupBy("source", "bin").agg(F.sum("n_tokens").alias("t"), F.first("need").alias("need"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    edges = binned.withColumn("before", F.coalesce(F.sum("t").over(upto), F.lit(0))).select("source", "bin", "before", (F.col("before") + F.col("t")).alias("after"), "need")
    # ranks below the bin in which the need is reached are taken, those above are not: one row a source says where it is
    reached = edges.groupBy("source").agg(F.min(F.when(F.col("after") > F.col("need"), F.struct("bin", "before"))).alias("at"))
    placed = due.join(F.broadcast(reached), "source", "left").withColumn("before", F.col("at.before"))
    beyond = F.col("bin") - F.col("at.bin")
    side = F.when(F.col("at").isNull() | (beyond < 0), "in").when((beyond == 0) & (F.col("before") < F.col("need")), "cut").otherwise("out")
    placed = placed.withColumn("side", F.when(F.col("bin").isNotNull(), side))
    inner = Window.partitionBy("source", "bin").orderBy("x", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.col("before") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))
    keep = ("doc_id", "source", "draw", "n_tokens", "whole", "pi", "need", "x")
    sure = placed.filter("side is null or side <> 'cut'").select(*keep, (F.col("side").eqNullSafe("in")).alias("take"))
    edge = placed.filter("side = 'cut'").withColumn("so_far", so_far).select(*keep, (F.col("so_far") + F.col("n_tokens") <= F.col("need")).alias("take"))
    taken = cut(sure.unionByName(edge), "mix-taken").df
    # the last place of a source goes to the document not taken that comes nearest to what is missing
    missing = F.broadcast(taken.groupBy("source").agg((F.first("need") - F.sum(F.when(F.col("take"), F.col("n_tokens")).otherwise(0))).alias("miss")))
    last = (
        taken.filter("pi > 0 and not take")
        .join(missing, "source")
        .withColumn("off", F.abs(F.col("miss") - F.col("n_tokens")))
        .filter("off < miss")
        .groupBy("source")
        .agg(F.min(F.struct("off", "x", "doc_id", "draw")).alias("p"))
        .select("source", F.col("p.doc_id").alias("last_id"), F.col("p.draw").alias("last_draw"))
    )
    is_last = F.col("draw").eqNullSafe(F.col("last_draw")) & F.col("doc_id").eqNullSafe(F.col("last_id"))
    chosen = (
        taken.join(F.broadcast(last), "source", "left")
        .select("doc_id", "source", "n_tokens", (F.col("whole") + (F.col("take") | is_last).cast("long")).alias("copies"))
        .filter("copies > 0")
    )
    known = spark.createDataFrame(
        [(s, share[s], float(target.get(s, 0.0)), int(available.get(s, 0)), target.get(s, 0.0) >= capacity.get(s, 0) - 1e-6) for s in share],
        "source string, target_share double, target_tokens double, available_tokens long, at_cap boolean",
    )
    used = chosen.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("actual_tokens"), F.count(F.lit(1)).alias("documents_used"), F.max("copies").alias("max_copies")
    )
    shares = known.join(used, "source", "left").na.fill(0, ["actual_tokens", "documents_used", "max_copies"])
    shares = shares.withColumn("actual_share", F.coalesce(F.try_divide(F.col("actual_tokens").cast("double"), F.sum("actual_tokens").over(Window.partitionBy(F.lit(1)))), F.lit(0.0)))
    return chosen, shares.select("source", "target_share", "actual_share", "target_tokens", "actual_tokens", "available_tokens", "documents_used", "max_copies", "at_cap")
