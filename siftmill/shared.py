"""Tables in the folder all executors share, and joins that survive hot keys.

Iterative operators cut their lineage by writing a table below the folder named in
``spark.checkpoint.dir``; a lost executor then costs a re-read, not a re-run.
"""

from __future__ import annotations

import atexit
import io
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds more than one row in so many; at most this many keys can be hot.
HOT_SHARE = 1000
#: Most rows of a table of few narrow columns that is broadcast.
FEW_ROWS = 100_000
#: Below so many rows a key is never hot, whatever its share.
HOT_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where that is unset (tests, one machine) a folder of our own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("siftmill.shared.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="siftmill-")
        spark.conf.set("siftmill.shared.dir", base)
    folder = f"{base.rstrip('/')}/siftmill/{spark.sparkContext.applicationId}"
    if folder not in _seen:
        _seen.add(folder)
        atexit.register(_cleanup_at_end, spark)
    return folder


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_seen: set[str] = set()


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cleanup(spark: SparkSession) -> None:
    """Delete this application's tables in the shared folder; nothing lazy may read them any more. Runs by itself when
    the driver ends."""
    delete_path(spark, shared_dir(spark))


def _cleanup_at_end(spark: SparkSession) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            cleanup(spark)
    except Exception:  # noqa: BLE001  the session is gone already
        pass


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once an application, so that they need not have it installed."""
    key = f"{spark.sparkContext.applicationId}/package"
    if key in _seen:
        return
    _seen.add(key)
    home, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    path = f"{shared_dir(spark)}/{home.name}.zip"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(data.getvalue()))
    finally:
        out.close()
    spark.sparkContext.addPyFile(path)


class Table:
    """A written table: ``df`` reads it back, ``rows`` is its row count, ``sums`` the sums asked for."""

    def __init__(self, df: DataFrame, path: str, rows: int, sums: dict[str, int]):
        self.df, self.path, self.rows, self.sums = df, path, rows, sums

    def drop(self) -> None:
        """Delete the files; only once nothing lazy reads them any more."""
        delete_path(self.df.sparkSession, self.path)


def cut(df: DataFrame, name: str, sums: dict[str, Column] | None = None) -> Table:
    """Write ``df`` to the shared folder and read it back without lineage; counts come from the same job."""
    spark, path = df.sparkSession, table_path(df.sparkSession, name)
    seen = Observation()
    extra = [F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in (sums or {}).items()]
    df.observe(seen, F.count(F.lit(1)).alias("__rows"), *extra).write.parquet(path)
    got = seen.get
    back = spark.read.schema(df.schema).parquet(path)
    return Table(back, path, int(got.get("__rows") or 0), {k: int(got.get(k) or 0) for k in (sums or {})})


def spread(df: DataFrame) -> DataFrame:
    """A scan ahead of costly Python work, over at least as many tasks as there are cores; large inputs have more of
    their own and stay as they are. Only for inputs without a shuffle, as the plan is asked for its partitions."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if its ``rows``, counted by the caller, are few; else left to an ordinary join."""
    return F.broadcast(df) if rows <= FEW_ROWS else df


def hot_limit(rows: int) -> int:
    """Rows above which a key counts as hot: at most ``HOT_SHARE`` keys can exceed it."""
    return max(HOT_ROWS, rows // HOT_SHARE)


def join_by_key(many: DataFrame, one: DataFrame, key: str, weight: str, rows: int, how: str = "inner") -> DataFrame:
    """Join ``many`` (any skew) with ``one`` (unique ``key``) without sending a hot key to one task.

    ``one[weight]`` says how many rows of ``many`` carry its key, ``rows`` how many there are in all. Keys above
    ``hot_limit`` are at most ``HOT_SHARE`` by arithmetic, so they are broadcast; the others shuffle. ``how`` is
    ``inner`` or ``left_semi``.
    """
    limit = hot_limit(rows)
    if rows <= limit:
        return many.join(one.drop(weight), key, how)
    hot, cold = one.filter(F.col(weight) > limit).drop(weight), one.filter(F.col(weight) <= limit).drop(weight)
    marks = F.broadcast(hot.select(F.col(key).alias("__hot")))
    rest = many.join(marks, F.col(key) == F.col("__hot"), "left_anti")
    return many.join(F.broadcast(hot), key, how).unionByName(rest.join(cold, key, how))
