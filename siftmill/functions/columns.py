"""Scalar functions on columns: names, paths, texts, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of names that mark an explicit copy, matched against the whole base name.
COPY_PATTERNS = (
    r"^.+\s\(\d+\)(\.\w+)?$",
    r"^[Cc]opy\s+of\s+.+$",
    r"^.+\s-\s[Cc]opy(\s\(\d+\))?(\.\w+)?$",
)

# Media types by file name ending.
MIME_BY_ENDING = {
    "pdf": "application/pdf",
    "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "odt": "application/vnd.oasis.opendocument.text",
    "rtf": "application/rtf",
    "html": "text/html",
    "htm": "text/html",
    "txt": "text/plain",
    "csv": "text/csv",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "zip": "application/zip",
}
DEFAULT_MIME = "application/octet-stream"

# Media types whose text is compared.
DOCUMENT_MIMES = (
    "application/pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "application/msword",
    "text/html",
)

# Strategy names and their short labels.
STRATEGY_LABELS = {"exact-hash": "Exact", "near-dup-image": "Image", "near-dup-document": "Document"}


def base_name(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def copy_hint(path: Column) -> Column:
    """'explicit_copy' if the base name looks like a copy's, else null; null and blank names have none."""
    name = base_name(path)
    hit = F.lit(False)
    for p in COPY_PATTERNS:
        hit = hit | name.rlike(p)
    return F.when(hit & (F.trim(name) != ""), F.lit("explicit_copy"))


def mime_of(path: Column) -> Column:
    """Media type by the base name's ending, 'application/octet-stream' if unknown or missing."""
    ending = F.lower(F.regexp_extract(base_name(path), r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*(F.lit(x) for kv in MIME_BY_ENDING.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.coalesce(ending, F.lit(""))), F.lit(DEFAULT_MIME))


def clean_mime(mime: Column) -> Column:
    return F.lower(F.trim(F.split_part(mime, F.lit(";"), F.lit(1))))


def handler_of(mime: Column) -> Column:
    """Which comparison a media type gets, in the order document, image, generic."""
    return F.when(mime.isin(*DOCUMENT_MIMES), "document").when(mime.startswith("image/"), "image").otherwise("generic")


def near_dup_strategy(mime: Column) -> Column:
    return F.when(mime.startswith("image/"), "near-dup-image").otherwise("near-dup-document")


def is_under(path: Column, root: str) -> Column:
    """Whether path is root or below it, by whole components."""
    clean = root.rstrip("/") or "/"
    return (path == clean) | path.startswith(clean.rstrip("/") + "/")


def ancestors(path: Column) -> Column:
    """The path itself and each of its parent folders, by whole components."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def normalise_text(text: Column) -> Column:
    """Lower case, every run of other than a-z and 0-9 one blank, none around."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def shingles(text: Column) -> Column:
    """Distinct word pairs of the normalised text. One word stands for itself; blank or null text has none; a text
    without any ASCII letter or digit has the empty shingle."""
    words = F.split(normalise_text(text), " ")
    pairs = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    some = F.when(F.size(words) == 1, words).otherwise(F.array_distinct(pairs))
    return F.when(text.isNull() | (F.trim(text, F.lit(" \t\n\r\f\x0b")) == ""), F.array().cast("array<string>")).otherwise(some)


def strip_markup(text: Column) -> Column:
    """Text of HTML: scripts, styles, comments and tags become blanks, common entities their characters."""
    t = F.regexp_replace(text, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[a-zA-Z/!][^>]*>", " ")
    for entity, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(ch))
    return F.trim(F.regexp_replace(t, r"[ \t]+", " "))


def format_bytes(n: Column) -> Column:
    """'n B', one decimal in KB and MB, two in GB, by powers of 1024; halves round up."""
    k = F.lit(1024).cast("double")
    dec = lambda x, d: F.format_string(f"%.{d}f", x)
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, F.concat(dec(n / k, 1), F.lit(" KB")))
        .when(n < 1024**3, F.concat(dec(n / (k * k), 1), F.lit(" MB")))
        .when(n >= 1024**3, F.concat(dec(n / (k * k * k), 2), F.lit(" GB")))
    )


def short_path(path: Column) -> Column:
    """The last two segments behind an ellipsis if the path has more than three; '' for null."""
    parts = F.split(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+$", ""), "/")
    cutoff = F.concat(F.lit("…/"), F.element_at(parts, -2), F.lit("/"), F.element_at(parts, -1))
    return F.coalesce(F.when(F.size(parts) > 3, cutoff).otherwise(path), F.lit(""))


def strategy_label(strategy: Column) -> Column:
    out = strategy
    for name, label in STRATEGY_LABELS.items():
        out = F.when(strategy == name, label).otherwise(out)
    return out


def duration(seconds: Column, padded: bool = False) -> Column:
    """'Xh Ym Zs', without the leading zero units; ``padded`` writes minutes after hours, and seconds, in two digits."""
    n = seconds.cast("long")
    h, m, s = F.floor(n / 3600), F.floor((n % 3600) / 60), n % 60
    two = "%02d" if padded else "%d"
    return (
        F.when(n >= 3600, F.format_string(f"%dh {two}m {two}s", h, m, s))
        .when(n >= 60, F.format_string(f"%dm {two}s", m, s))
        .otherwise(F.concat(n.cast("string"), F.lit("s")))
    )


def archive_path(root: Column, run: Column, path: Column) -> Column:
    """Where a file goes below an archive root: {root}/run_{id}[/{drive}]/{path without its root}."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    drive = F.regexp_extract(slashed, r"^([A-Za-z]):/", 1)
    rest = F.regexp_replace(slashed, r"^([A-Za-z]:)?/+", "")
    return F.concat(F.coalesce(root, F.lit("")), F.lit("/run_"), run.cast("string"), F.when(drive != "", F.concat(F.lit("/"), drive)).otherwise(""), F.lit("/"), rest)


def settings_fingerprint(threshold: Column, min_similarity: Column) -> Column:
    return F.concat_ws("|", threshold.cast("string"), min_similarity.cast("string"))


def age(seconds: Column) -> Column:
    """'Xs' below a minute, 'Xm' below an hour, else 'Xh Ym'; null for null."""
    n = seconds.cast("long")
    return (
        F.when(n < 60, F.concat(n.cast("string"), F.lit("s")))
        .when(n < 3600, F.concat(F.floor(n / 60).cast("string"), F.lit("m")))
        .when(n >= 3600, F.format_string("%dh %dm", F.floor(n / 3600), F.floor((n % 3600) / 60)))
    )


def display_date(at: Column) -> Column:
    return F.date_format(at, "yyyy-MMM-dd HH:mm:ss")


def run_label(at: Column) -> Column:
    return F.concat(F.lit("run_"), F.date_format(at, "yyyyMMdd_HHmmss"))


def confidence_badge(strategy: Column, confidence: Column) -> Column:
    return F.when(strategy == "exact-hash", "success").when(confidence >= 0.8, "contrast").otherwise("error")


def percent(share: Column) -> Column:
    return F.format_string("%.0f%%", share * 100)


def csv_quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
