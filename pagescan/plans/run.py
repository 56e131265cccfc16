"""From a list of targets to findings, what was scanned, errors and totals, in one call and one pass over the pages."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pagescan.operators import rollups
from pagescan.plans.scan import errors_of, findings_of, scan
from pagescan.schema import FINDINGS
from pagescan.sources.files import file_errors, file_pages
from pagescan.sources.pages import classify_targets, fetch_errors, first_of_location, web_pages


@dataclass(frozen=True)
class Run:
    """What a scan left in its folder: findings, errors (location, stage, message) and how much was scanned."""

    findings: DataFrame
    errors: DataFrame
    counters: dict

    def summary(self) -> DataFrame:
        return rollups.summary(self.findings)

    def verdict(self) -> DataFrame:
        return rollups.verdict(self.findings)


def run_scan(pages: DataFrame, folder: str, mode: str = "deep", keywords=None, rules=(), extra=(), failed: DataFrame | None = None) -> Run:
    """Scans ``pages(page_id, location, content)`` into ``folder``, which must be one that all executors see.

    Findings and errors are written by the same job, which reads the pages once and counts them on the way; errors in
    ``failed`` (location, stage, message), of pages that could not be read, are put to them.
    """
    spark, seen = pages.sparkSession, Observation()
    is_url = F.col("location").rlike("(?i)^https?://")
    counted = pages.observe(seen, F.count_if(is_url).alias("urls"), F.count_if(~F.coalesce(is_url, F.lit(False))).alias("files"))
    rows = scan(counted, mode, keywords, rules, extra, errors=True).withColumn(
        "part", F.expr("IF(startswith(rule_id, '#'), 'error', 'finding')"))
    rows.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/scan")
    stored = spark.read.schema(FINDINGS + ", part STRING").parquet(f"{folder}/scan").drop("part")
    errors = errors_of(stored)
    counts = seen.get
    if failed is not None:
        failed.select("location", "stage", "message").write.mode("overwrite").parquet(f"{folder}/unread")
        unread = spark.read.schema("location STRING, stage STRING, message STRING").parquet(f"{folder}/unread")
        # A page that could not be fetched was looked at, an unreadable file was not.
        counts["urls"] += unread.where("stage = 'fetch'").count()
        errors = errors.unionByName(unread)
    return Run(findings_of(stored), errors, {
        "scanned_files": counts["files"], "scanned_urls": counts["urls"], "total_scanned": counts["files"] + counts["urls"]})


def scan_targets(targets: DataFrame, fetched: DataFrame, files: DataFrame | None, folder: str, **options) -> Run:
    """Scans what the ``target`` rows name: pages ``fetched(url, html)`` by their address, ``files(location, content BINARY)``
    by their path or a folder above it.

    A target that was not fetched is an error, as is one without content; each location is scanned once.
    """
    kinds = classify_targets(targets.distinct())
    urls = kinds.where("endswith(target_type, '_url')").select(F.col("target").alias("_url"))
    web = urls.join(fetched.select("url", "html"), F.col("_url") == F.col("url"), "left").select(
        F.xxhash64("_url").alias("page_id"), F.col("_url").alias("url"), "html")
    pages, failed = web_pages(web), fetch_errors(web)
    if files is not None:
        paths = kinds.where("NOT endswith(target_type, '_url')").select(F.regexp_replace("target", "(.)/+$", "$1").alias("_path"))
        above = F.expr("transform(sequence(1, size(split(location, '/'))), n -> array_join(slice(split(location, '/'), 1, n), '/'))")
        # Found on the names alone; contents move once.
        named = files.select("location").distinct().withColumn("_above", F.explode(F.array_distinct(above))).join(
            paths, F.col("_above") == F.col("_path"), "left_semi").select("location").distinct()
        taken = files.join(named, "location", "left_semi")
        pages, failed = pages.unionByName(file_pages(taken)), failed.unionByName(file_errors(taken))
    return run_scan(first_of_location(pages), folder, failed=failed, **options)


def counters(run: Run) -> DataFrame:
    """The counters of a run as one row, with the number of its errors."""
    return run.errors.agg(F.count(F.lit(1)).alias("errors")).select(
        *[F.lit(v).cast("long").alias(k) for k, v in run.counters.items()], "errors")
