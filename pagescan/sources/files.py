"""Directories of files as scan input."""

import fnmatch
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagescan.functions.dialect import to_java
from pagescan.functions.text import lit
from pagescan.rules import values as V
from pagescan.sources.pages import has_extension


def excluded(path: str, patterns) -> str:
    """SQL: does a path match an exclude pattern?  ``*`` crosses slashes; ``dir/`` is a prefix."""
    tests = [f"rlike({path}, {lit('^' + to_java(fnmatch.translate(p)))})" for p in patterns]
    tests += [f"startswith({path}, {lit(p.rstrip('/'))})" for p in patterns if p.endswith("/")]
    return f"({' OR '.join(tests)})" if tests else "false"


def selected(path: str, base: str, mode: str = "deep", depth: int = 3, exclude=()) -> str:
    """SQL: is a file below ``base`` taken?  Hidden names, other extensions, deeper folders
    and excluded files or folders are not."""
    base = base.rstrip("/")
    inner = f"split(substring({path}, {len(base) + 2}, length({path})), '/')"
    prefixes = (f"transform(sequence(1, size({inner})), n -> concat({lit(base + '/')}, "
                f"array_join(slice({inner}, 1, n), '/')))")
    return (f"(startswith({path}, {lit(base + '/')}) AND size({inner}) <= {depth} + 1 "
            f"AND NOT exists({inner}, part -> startswith(part, '.')) AND {has_extension(path, mode)} "
            f"AND NOT exists({prefixes}, prefix -> {excluded('prefix', exclude)}))")


def is_binary(content: str) -> str:
    """SQL: does a file start like a binary one?  Looks at 1,024 bytes; empty files are text."""
    head = f"decode(substring({content}, 1, 1024), 'ISO-8859-1')"
    text = r"'[\\x07-\\x0a\\x0c\\x0d\\x1b\\x20-\\xff]'"
    other = f"length(regexp_replace({head}, {text}, ''))"
    return f"(contains({head}, '\\0') OR coalesce(try_divide({other}, length({head})) > 0.3, false))"


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("charset", T.StringType())]))
def _decoded(contents: pd.Series) -> pd.DataFrame:
    """Text of files that are not UTF-8."""
    def decode(raw):
        if raw is None:
            return None, None
        try:
            return raw.decode("gb18030"), "gb18030"
        except UnicodeDecodeError:
            return raw.decode("latin-1"), "latin-1"

    return pd.DataFrame([decode(raw) for raw in contents], columns=["text", "charset"])


def decode_files(files: DataFrame, max_chars: int | None = None) -> DataFrame:
    """``files(location, content BINARY)`` as text with the charset used: UTF-8 where valid,
    else GB 18030, else Latin-1.  ``max_chars`` cuts long files (the whole file by default)."""
    text = "CAST(content AS STRING)"
    valid = F.expr(f"is_valid_utf8({text})")
    parts = files.withColumn("other", _decoded(F.when(~valid, F.col("content")))).withColumn("valid", valid)
    cut = "{}" if max_chars is None else f"left({{}}, {max_chars})"
    kept = [c for c in files.columns if c != "content"]
    return parts.selectExpr(
        *kept, cut.format(f"IF(valid, regexp_replace({text}, '^﻿', ''), other.text)") + " AS content",
        "IF(valid, 'utf-8', other.charset) AS charset")


def _qualified(spark: SparkSession, directory: str) -> str:
    """A directory as its file system names it in full, not percent-encoded."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def location(path: str) -> str:
    """SQL: a file's location from its encoded URI: the path for local files, else the whole URI, decoded."""
    decoded = f"try_url_decode(replace({path}, '+', '%2B'))"
    return f"regexp_replace({decoded}, '^file:/+', '/')"


def list_files(spark: SparkSession, directory: str, mode: str = "deep", depth: int = 3, exclude=()) -> DataFrame:
    """The files of a directory tree a scan takes: location and content, read lazily.

    The directory may be relative or on any storage Spark knows; locations keep scheme and host, but
    for local files.  The conditions are on the file name only, so Spark drops files before opening them.
    """
    base = re.sub("^file:/+", "/", _qualified(spark, directory))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    path = location("_metadata.file_path")
    return files.where(selected(path, base, mode, depth, exclude)).selectExpr(f"{path} AS location", "content")


def file_pages(files: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Scan input from ``files(location, content BINARY)``: binary and empty files left out."""
    text = decode_files(files.where(f"NOT {is_binary('content')}"), max_chars)
    return text.where("content != ''").selectExpr("xxhash64(location) AS page_id", "location", "content")


def file_errors(files: DataFrame) -> DataFrame:
    """One row per file without content."""
    return files.where("octet_length(content) = 0").selectExpr(
        "location", "'read' AS stage", f"concat({lit(V.ERROR_UNREADABLE)}, location) AS message")
