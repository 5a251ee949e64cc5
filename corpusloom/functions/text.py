"""Column functions of the retrieval engine: tokens, vectors, identifiers, parsing with defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories, extensions and name endings that an index leaves out.
SKIPPED_DIRECTORIES = ["node_modules", "vendor", "dist", "build", "coverage", ".next", ".venv"]
BINARY_SUFFIXES = [
    "7z", "avi", "bmp", "class", "doc", "docx", "eot", "gif", "gz", "ico", "jar", "jpeg", "jpg", "lockb", "mov", "mp3", "mp4",
    "o", "obj", "otf", "pdf", "png", "pyc", "so", "tar", "ttf", "wav", "webm", "webp", "woff", "woff2", "xls", "xlsx", "zip",
]


def tokens(text: Column) -> Column:
    """Runs of A-Z, a-z, 0-9 and _ of the text as it is, then lower-cased; empty for null."""
    found = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_]+)"), F.lit(1))
    return F.coalesce(F.transform(found, F.lower), F.array().cast("array<string>"))


def words(text: Column) -> Column:
    """Distinct lower-case words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double; the longer vector's rest is left out."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.coalesce(p["a"].cast("double") * p["b"].cast("double"), F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either has length 0."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def number(value: Column) -> Column:
    """A number or numeric text as double, else 0."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(0.0)


def skip_reason(path: Column) -> Column:
    """Why a file isn't indexed, or null: skipped directory, then minified name, then binary suffix."""
    parts = F.split(F.lower(path), "/")
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return (
        F.when(F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED_DIRECTORIES))), "generated_or_dependency_path")
        .when(path.rlike(r"\.min\.(js|mjs|cjs)$"), "minified_file")
        .when(suffix.isin(BINARY_SUFFIXES), "unsupported_language")
    )


def content_problem(text: Column) -> Column:
    """Why a text isn't chunked, or null: empty, generated by a tool, or minified."""
    lines = F.split(text, r"\r?\n")
    head = F.lower(F.array_join(F.slice(F.split(text, r"\r?\n", 7), 1, 6), "\n"))  # long texts aren't split for their first lines
    longest = F.array_max(F.transform(lines, F.length))
    marked = head.contains("@generated") | head.contains("code generated") | head.contains("do not edit")
    return (
        F.when(~text.rlike(r"(?U)\S"), "empty_file")
        .when(marked, "generated_file")
        .when((F.length(text) > 20000) & (longest > 10000), "minified_file")
    )


def uuid5(name: Column, namespace: str = "6ba7b8119dad11d180b400c04fd430c8") -> Column:
    """Name-based UUID, version 5, of a name in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)
    )


def duration_seconds(text: Column) -> Column:
    """Seconds of texts such as 1m2.5s: the sum of ms, s, m and h parts."""
    parts = F.regexp_extract_all(text, F.lit(r"([0-9.]+)(ms|s|m|h)"), F.lit(0))

    def one(p: Column) -> Column:
        n = F.regexp_extract(p, r"([0-9.]+)", 1).try_cast("double")
        return n * F.when(p.endswith("ms"), 0.001).when(p.endswith("s"), 1.0).when(p.endswith("m"), 60.0).otherwise(3600.0)

    return F.aggregate(parts, F.lit(0.0), lambda s, p: s + F.coalesce(one(p), F.lit(0.0)))


def backoff(attempt: Column, most: float = 30.0) -> Column:
    return F.least(F.pow(F.lit(2.0), attempt), F.lit(most))


def token_estimate(chars: Column, completion: int) -> Column:
    return F.ceil(chars / 2).cast("long") + completion
