"""Scans: source trees and JSON inputs as tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.text import glob_pattern
from tributary.rules.catalogue import BINARY_EXTENSIONS, EXTENSIONS, MAX_FILE_BYTES, NAME_LANGUAGES, PHP_SKIP_PATHS, SKIP_DIRS, SKIP_PATHS, UNSUPPORTED_NAMES

#: JSON inputs: batches of findings, and of snippets.
FINDINGS = "array<struct<finding:string, snippets:array<string>>>"
SNIPPETS = "struct<codebase_path:string, snippets:array<struct<id:string, filename:string, context:array<string>>>>"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def language_of(path: Column) -> Column:
    """Language by the file's name, then by its extension; null for names that are never parsed and for unknown extensions."""
    name = F.lower(base_name(path))
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    pairs = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    out = pairs[extension]
    for language, names in NAME_LANGUAGES.items():
        out = F.when(name.isin(*names), language).otherwise(out)
    return F.when(~name.isin(*UNSUPPORTED_NAMES), out)


def is_binary(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]+)$", 1)).isin(*BINARY_EXTENSIONS)


def is_skipped(path: Column, parts: list[str] = SKIP_PATHS) -> Column:
    """The path holds a part that is skipped, in any case of letters."""
    out = F.lit(False)
    for x in parts:
        out = out | F.contains(F.lower(path), F.lit(x))
    return out


def is_skipped_php(path: Column) -> Column:
    out = F.lit(False)
    for x in PHP_SKIP_PATHS:
        out = out | F.contains(path, F.lit(x))
    return out


def scan(
    spark: SparkSession, root: str, languages: list[str] = (), include: list[str] = (), exclude: list[str] = (), skip_dirs: list[str] = SKIP_DIRS, max_bytes: int = MAX_FILE_BYTES
) -> DataFrame:
    """files: file_path, language, size_bytes, content, error. Files over max_bytes keep their row, without content.

    Paths are relative to root. Directories in skip_dirs, excluded globs and unknown languages are left out; include globs
    are matched with the base name. Bodies are read of the files that stay only: pruning goes by the listing, and larger files
    are rows of the listing. A file that isn't UTF-8 keeps its row and content, with replacement characters and an error.
    """
    top = root.rstrip("/")
    bare = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/", top)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    # The listing's own column prunes files before they are read. Its paths may be encoded, so what it can't tell is filtered after.
    listed, skipped = F.col("_metadata.file_path"), "|".join(re.escape(d) for d in skip_dirs)
    extensions = "|".join(re.escape(x) for x in [*EXTENSIONS, *(n for names in NAME_LANGUAGES.values() for n in names)])
    raw = raw.where(listed.rlike(rf"(?i)(?:[.]|/)(?:{extensions})$"))
    if skipped:
        raw = raw.where(~listed.rlike(re.escape(bare) + rf"/(?:.*/)?(?:{skipped})/"))
    path = F.regexp_replace(F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/"), "^.*?" + re.escape(bare) + "/", "")
    parents = F.slice(F.split("file_path", "/"), 1, F.greatest(F.size(F.split("file_path", "/")) - 1, F.lit(0)))

    def kept(rows: DataFrame) -> DataFrame:
        rows = rows.where(~F.arrays_overlap(parents, F.array(*map(F.lit, [*skip_dirs, ""])))).withColumn("language", language_of(F.col("file_path"))).where("language is not null")
        if languages:
            rows = rows.where(F.col("language").isin(*languages))
        for glob in exclude:
            rows = rows.where(~F.col("file_path").rlike(glob_pattern(glob)))
        if include:
            rows = rows.where(base_name(F.col("file_path")).rlike("|".join(f"(?:{glob_pattern(glob)})" for glob in include)))
        return rows

    none = F.lit(None).cast("string")
    # The size is a filter of the reader's: a larger body isn't opened. The second branch reads no body at all.
    small = kept(raw.where(F.col("length") <= max_bytes).select(path.alias("file_path"), F.col("length").alias("size_bytes"), F.col("content").cast("string").alias("body")))
    valid = F.is_valid_utf8(F.col("body"))
    small = small.select("file_path", "language", "size_bytes", F.make_valid_utf8(F.col("body")).alias("content"), F.when(~valid, "not UTF-8").alias("error"))
    large = kept(raw.where(F.col("length") > max_bytes).select(path.alias("file_path"), F.col("length").alias("size_bytes")))
    return small.unionByName(large.select("file_path", "language", "size_bytes", none.alias("content"), F.lit("file too large").alias("error")))


def findings(spark: SparkSession, path: str) -> DataFrame:
    """(finding, snippet_id, code): a JSON list of findings with snippets, or of plain snippets (one finding each)."""
    text = spark.read.text(path, wholetext=True)
    full = text.select(F.posexplode(F.from_json("value", FINDINGS)).alias("n", "f")).where("f.finding is not null").select(F.col("f.finding").alias("finding"), F.posexplode("f.snippets").alias("k", "code"), "n")
    full = full.select("finding", F.concat_ws("_", "finding", F.col("k").cast("string")).alias("snippet_id"), "code")
    plain = text.select(F.posexplode(F.from_json("value", "array<string>")).alias("n", "code")).where("code is not null and not code like '{%'")
    name = F.concat(F.lit("snippet_"), (F.col("n") + 1).cast("string"))
    return full.unionByName(plain.select(name.alias("finding"), name.alias("snippet_id"), "code"))


def snippet_batch(spark: SparkSession, path: str) -> DataFrame:
    """(codebase_path, snippet_id, filename, code) of a snippet batch; the context's lines are joined."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", SNIPPETS).alias("b"))
    rows = text.select(F.col("b.codebase_path").alias("codebase_path"), F.explode("b.snippets").alias("s"))
    return rows.select("codebase_path", F.col("s.id").alias("snippet_id"), F.col("s.filename").alias("filename"), F.array_join("s.context", "\n").alias("code"))


def first_files(files: DataFrame, n: int) -> DataFrame:
    """The first n files by path (0: all)."""
    return files.orderBy("file_path").limit(n) if n else files
