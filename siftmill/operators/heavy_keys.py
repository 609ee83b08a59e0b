"""Per-key results where a few keys hold most rows.

One pass feeds a frequent-items sketch; every key above its error bound is a heavy candidate, and their number is
bounded by the sketch, so they are broadcast. Rows of heavy keys are split by their distinct values, pre-aggregated
and summed in two steps; all others take an ordinary shuffle; both results are united.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Keys the sketch keeps at least and at most; its error is at most 3.5 / keys of all rows.
SKETCH_KEYS, SKETCH_KEYS_MAX = 4096, 1 << 19
#: Tasks whose sketches are merged in one place at first; a second step merges the merged ones.
MERGE_FAN_IN = 64
#: Share of all rows that makes a key heavy unless the caller says otherwise.
HEAVY_SHARE = 0.02


def clean_hash(c: Column) -> Column:
    return F.lower(F.trim(c))


def sketch_heavy(rows: DataFrame, keys: list[str], share: float) -> tuple[DataFrame, int]:
    """Keys that may hold ``share`` of all rows (all that do are among them), and the number of rows.

    The sketch over-counts nothing by more than its error, so keys from ``share`` minus the error on are kept: at most
    1 / (share - error) of them. Smaller shares take larger sketches; below 16 / SKETCH_KEYS_MAX it is an error.
    """
    kept = max(SKETCH_KEYS, 1 << (int(16 / share)).bit_length()) if share > 0 else SKETCH_KEYS_MAX + 1
    if kept > SKETCH_KEYS_MAX:
        raise ValueError(f"a share of {share} of all rows is too small to be heavy")
    spark = rows.sparkSession
    text = F.concat_ws("\x01", *(F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys))
    most = int(2 / share) + 2
    tasks = rows.rdd.getNumPartitions()  # planned only, nothing runs
    first = rows.select(text.alias("__key"), F.pmod(F.spark_partition_id(), F.lit(max(1, tasks // MERGE_FAN_IN))).alias("__at"))
    merged = first.groupBy("__at").agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k_accumulate(__key, {kept})").alias("s"))
    whole = merged.groupBy(F.lit(1)).agg(F.sum("n").alias("n"), F.expr(f"approx_top_k_combine(s, {kept})").alias("s"))
    got = whole.select("n", F.expr(f"approx_top_k_estimate(s, {most})").alias("top")).first() or Row(n=0, top=[])
    bound = got.n * max(0.0, share - 4.0 / kept)
    found = [x.item for x in (got.top or []) if x["count"] >= bound and x.item is not None]
    parts = F.split("t", "\x01")
    heavy = spark.createDataFrame([(t,) for t in found], "t string")
    cols = [F.when(parts[i] != "\x00", parts[i]).cast(rows.schema[k].dataType).alias(k) for i, k in enumerate(keys)]
    return heavy.select(*cols), got.n


def per_key_results(rows: DataFrame, keys: list[str], value: str, size: str, share: float = HEAVY_SHARE) -> DataFrame:
    """For every key: rows, distinct non-null ``value``, the sum of ``size`` and whether it is heavy.

    Output: keys, n_rows long, n_values long, total_size long, is_heavy boolean (n_rows at least ``share`` of all rows).
    Null parts of a key form keys of their own; null values count as rows but not as values, null sizes as 0.
    An empty input gives no rows. No task holds more than one value of a heavy key, and none that is not heavy is large.
    """
    heavy, total = sketch_heavy(rows, keys, share)
    need = rows.select(*keys, F.col(value).alias("__v"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("__s"))
    marks = F.broadcast(heavy.select(*(F.col(k).alias(f"__h_{k}") for k in keys)))
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"__h_{k}"))
        same = one if same is None else same & one
    is_heavy = (F.col("n_rows") >= F.lit(share * total)).alias("is_heavy")
    out = (*keys, "n_rows", "n_values", "total_size", is_heavy)
    # heavy: by value first, which spreads a key over all tasks, then the few sums of each key
    by_value = need.join(marks, same, "left_semi").groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("n"), F.sum("__s").alias("s"))
    hot = by_value.groupBy(*keys).agg(F.sum("n").alias("n_rows"), F.count("__v").alias("n_values"), F.sum("s").alias("total_size")).select(*out)
    rest = need.join(marks, same, "left_anti").groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("n"), F.sum("__s").alias("s"))
    cold = rest.groupBy(*keys).agg(F.sum("n").alias("n_rows"), F.count("__v").alias("n_values"), F.sum("s").alias("total_size")).select(*out)
    return hot.unionByName(cold)


def candidate_rows(files: DataFrame) -> DataFrame:
    """files as (size, hash_partial, hash_full) with hashes trimmed and in lower case."""
    return files.select(F.col("size").cast("long").alias("size"), clean_hash(F.col("hash_partial")).alias("hash_partial"), clean_hash(F.col("hash_full")).alias("hash_full"))


def candidate_key_results(files: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """Per candidate key (size, hash_partial): n_rows, n_values (distinct hash_full), total_size, is_heavy."""
    rows = candidate_rows(files).withColumn("bytes", F.col("size"))
    return per_key_results(rows, ["size", "hash_partial"], "hash_full", "bytes", share)


def heavy_candidate_keys(files: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """(size, hash_partial) of the heavy candidate keys with a partial hash; a null size is a size like any other."""
    return candidate_key_results(files, share).filter("is_heavy and hash_partial is not null").select("size", "hash_partial")
