"""Tables of web pages, target lists, and target types."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescan.functions.text import has_match, lit, lits
from pagescan.rules import values as V


def web_pages(table: DataFrame, page_id="page_id", url="url", html="html") -> DataFrame:
    """A fetched-page table as scan input; pages without content are left out (see errors)."""
    return table.selectExpr(f"{page_id} AS page_id", f"{url} AS location", f"{html} AS content").where(
        "content IS NOT NULL")


def fetch_errors(table: DataFrame, url="url", html="html") -> DataFrame:
    """One row per page that has no content."""
    return table.where(f"{html} IS NULL").selectExpr(
        f"{url} AS location", "'fetch' AS stage", f"concat({lit(V.ERROR_FETCH)}, {url}) AS message")


def first_of_location(pages: DataFrame) -> DataFrame:
    """Each location once, NULL as one of them, with its lowest page_id; of several contents under that
    id the one with the least hash, and of equal rows one.

    The winners are found on narrow columns, where partial aggregation takes care of
    a location that is most of the table; content moves once, spread by location and page_id.
    """
    mark = F.xxhash64("content")
    first = pages.groupBy("location").agg(F.min(F.struct("page_id", mark.alias("mark"))).alias("first")).select(
        F.col("location").alias("_location"), F.col("first.page_id").alias("_page_id"), F.col("first.mark").alias("_mark"))
    won = (F.col("location").eqNullSafe(F.col("_location")) & F.col("page_id").eqNullSafe(F.col("_page_id"))
           & (mark == F.col("_mark")))
    return pages.join(first, won, "left_semi").select(*pages.columns).dropDuplicates(["location", "page_id"])


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    return clean_targets(spark.read.text(path))


def clean_targets(lines: DataFrame) -> DataFrame:
    """One target per line, trimmed, blank lines dropped."""
    trimmed = r"regexp_replace(value, '^[\\s\\x1c-\\x1f\\x85\\p{Z}]+|[\\s\\x1c-\\x1f\\x85\\p{Z}]+$', '') AS target"
    return lines.selectExpr(trimmed).where("target != ''")


def classify_targets(targets: DataFrame) -> DataFrame:
    """Adds ``target_type``; paths count as files if they have an extension."""
    host = "get(split(get(split(target, '/'), 2), ':'), 0)"
    return targets.selectExpr("*", f"""CASE
        WHEN startswith(target, 'http://') OR startswith(target, 'https://') THEN
            IF({has_match(host, V.INTERNAL_HOST)}, 'internal_url', 'external_url')
        WHEN rlike(target, '\\\\.[^./]+$') THEN 'local_file' ELSE 'local_directory' END AS target_type""")


def extensions(mode: str) -> list[str]:
    """File extensions scanned in a mode."""
    if mode not in ("fast", "standard", "deep"):
        raise ValueError(f"unknown mode: {mode}")
    return sorted(V.HTML_EXTENSIONS + (V.CSS_EXTENSIONS + V.JS_EXTENSIONS if mode != "fast" else []))


def extension(path: str) -> str:
    """SQL for the lower-cased extension of a path, '' without one."""
    return rf"lower(regexp_extract({path}, '[^/.][^/]*?(\\.[^./]*)$', 1))"


def has_extension(path: str, mode: str) -> str:
    return f"{extension(path)} IN ({lits(extensions(mode))})"
