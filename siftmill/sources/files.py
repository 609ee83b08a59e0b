"""Scans of file trees: listing, metadata, content hashes, images."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.functions.columns import copy_hint, is_under, mime_of
from siftmill.functions.fingerprints import PARTIAL_BYTES, image_dhash

#: Names that the image reader is given.
IMAGE_NAMES = "*.{jpg,jpeg,png,gif,bmp,JPG,JPEG,PNG,GIF,BMP}"
#: Bytes of a file read at once.
CHUNK = 8 << 20


def _local(root: str) -> str | None:
    """The path of a local root, None if it is on another file system."""
    if root.startswith("file:"):
        return root.split(":", 1)[1].replace("///", "/")
    return root if "://" not in root else None


def local_path(uri):
    """A local file's plain path; other URIs as they are. Spark's readers name files without escapes."""
    return F.regexp_replace(uri, "^file:/+", "/")


def _reader(spark: SparkSession):
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true")


def list_files(spark: SparkSession, roots: list[str], excluded: list[str] = ()) -> DataFrame:
    """(path, size, modified_at, provider, mime_type, copy_hint) of the regular files with content below the roots.

    Missing local roots are skipped; a root that is a file is that file. ``excluded`` leaves out a folder and all
    below it, by whole components. Contents are not read.
    """
    here = [r for r in roots if _local(r) is None or os.path.exists(_local(r))]
    if not here:
        empty = "path string, length long, modificationTime timestamp"
        found = spark.createDataFrame([], empty)
    else:
        found = _reader(spark).load(here).select("path", "length", "modificationTime").distinct()
    path = local_path(F.col("path"))
    rows = found.select(
        path.alias("path"),
        F.col("length").alias("size"),
        F.col("modificationTime").cast("timestamp_ntz").alias("modified_at"),
        F.lit("local").alias("provider"),
        mime_of(path).alias("mime_type"),
        copy_hint(path).alias("copy_hint"),
    ).filter("size > 0")
    for root in excluded:
        rows = rows.filter(~is_under(F.col("path"), root))
    return rows


def _hasher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads, wholes = [], []
        for path, whole in zip(batch.column("path").to_pylist(), batch.column("whole").to_pylist()):
            head = full = None
            try:
                system, where = fs.FileSystem.from_uri(path if "://" in path else "file://" + quote(path))
                with system.open_input_stream(where) as f:
                    first = f.read(PARTIAL_BYTES)
                    head = hashlib.sha256(first).hexdigest()
                    if whole:
                        h = hashlib.sha256(first)
                        while chunk := f.read(CHUNK):
                            h.update(chunk)
                        full = h.hexdigest()
            except OSError:  # gone or unreadable since it was listed: no hash
                pass
            heads.append(head)
            wholes.append(full)
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(heads, pa.string()), pa.array(wholes, pa.string())], ["path", "hash_partial", "hash_full"])


def hash_files(paths: DataFrame, whole: bool = False) -> DataFrame:
    """(path, hash_partial, hash_full) of the files in ``paths`` (path); the full hash only if ``whole``.

    Heads of 4,096 bytes are read alone; whole files are read in chunks, so they may be of any size. Files that cannot be
    read have null hashes.
    """
    spark = paths.sparkSession
    todo = paths.select("path").filter("path is not null").distinct().repartition(max(spark.sparkContext.defaultParallelism, 1) * 4, "path")
    return todo.withColumn("whole", F.lit(whole)).mapInArrow(_hasher, "path string, hash_partial string, hash_full string")


def _read_whole(path: str) -> bytes | None:
    try:
        system, where = fs.FileSystem.from_uri(path if "://" in path else "file://" + quote(path))
        with system.open_input_stream(where) as f:
            return f.read()
    except OSError:
        return None


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():  # one file a batch: texts may be long
            data = _read_whole(path)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([None if data is None else data.decode("utf-8", "replace")], pa.string())], ["path", "text"])


def read_texts(paths: DataFrame) -> DataFrame:
    """(path, text) of the files in ``paths`` (path), as UTF-8 with a mark for what is not; null for unreadable ones."""
    parts = max(paths.sparkSession.sparkContext.defaultParallelism, 1) * 4
    return paths.select("path").filter("path is not null").distinct().repartition(parts, "path").mapInArrow(_texts, "path string, text string")


def fingerprint_images(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path, fingerprint) by difference hash of the files named as images below the roots; undecodable ones are dropped,
    tiny images have none."""
    here = [r for r in roots if _local(r) is None or os.path.exists(_local(r))]
    if not here:
        return spark.createDataFrame([], "path string, fingerprint binary")
    images = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", IMAGE_NAMES).load(here)
    return images.select(local_path(F.col("image.origin")).alias("path"), image_dhash(F.col("image")).alias("fingerprint"))
