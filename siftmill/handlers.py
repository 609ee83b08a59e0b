"""What is compared how: handlers of media types, in the order in which they are asked."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.functions.columns import DOCUMENT_MIMES


@dataclass(frozen=True)
class Handler:
    """``takes`` a column of clean media types; ``fingerprint`` gives (path, fp) of the files (path) it takes below the
    roots, ``links``
    gives (id_a, id_b, similarity, n_a, n_b) between classes of (id, kind, size, fp), ``strategy`` names such pairs."""

    name: str
    takes: Callable[[Column], Column]
    strategy: str | None = None
    fingerprint: Callable[[SparkSession, DataFrame, list[str]], DataFrame] | None = None
    links: Callable[[DataFrame, float], DataFrame] | None = None


def _html_fingerprints(spark: SparkSession, paths: DataFrame, roots: list[str]) -> DataFrame:
    from siftmill.functions.columns import strip_markup
    from siftmill.functions.fingerprints import signature, signature_bytes
    from siftmill.sources.files import read_texts

    return read_texts(paths.filter(F.lower("path").rlike(r"\.html?$"))).select("path", signature_bytes(signature(strip_markup(F.col("text")))).alias("fp"))


def _document_links(records: DataFrame, min_similarity: float) -> DataFrame:
    from siftmill.functions.fingerprints import signature_numbers
    from siftmill.operators.dedup import near_duplicate_classes

    signed = records.filter(F.octet_length("fp") == 1024)
    return near_duplicate_classes(signed.select("id", "kind", "size", signature_numbers(F.col("fp")).alias("sig")), min_similarity)


def _image_fingerprints(spark: SparkSession, paths: DataFrame, roots: list[str]) -> DataFrame:
    from siftmill.sources.files import fingerprint_images

    return fingerprint_images(spark, roots).join(paths, "path", "left_semi").select("path", F.col("fingerprint").alias("fp"))


def _image_links(records: DataFrame, min_similarity: float) -> DataFrame:
    from siftmill.operators.dedup import MIN_SIMILARITY_IMAGE, image_links

    return image_links(records.select("id", "kind", "fp"), max(min_similarity, MIN_SIMILARITY_IMAGE))


#: Asked in turn; the last takes everything. Others may be put ahead of it.
HANDLERS: list[Handler] = [
    Handler("document", lambda m: m.isin(*DOCUMENT_MIMES), "near-dup-document", _html_fingerprints, _document_links),
    Handler("image", lambda m: m.startswith("image/"), "near-dup-image", _image_fingerprints, _image_links),
    Handler("generic", lambda m: F.lit(True)),
]


def register(handler: Handler) -> None:
    """Ask this handler first."""
    HANDLERS.insert(0, handler)


def handler_name(mime: Column) -> Column:
    """The name of the first handler that takes a clean media type."""
    out = F.lit(None).cast("string")
    for h in reversed(HANDLERS):
        out = F.when(F.coalesce(h.takes(mime), F.lit(False)), h.name).otherwise(out)
    return out
