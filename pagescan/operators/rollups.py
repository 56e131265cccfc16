"""Counts, shares and verdicts over findings."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagescan.functions.text import lit
from pagescan.rules import values as V

COUNTED = {"suspicious_urls": "suspicious_url", "keyword_matches": "keyword_match",
           "hidden_elements": "hidden_element", "js_issues": "js_issue", "css_issues": "css_issue"}
LEVELS = {"critical": "severity >= 8", "high": "severity BETWEEN 5 AND 7",
          "medium": "severity BETWEEN 3 AND 4", "low": "severity <= 2"}


def _counts(conditions: dict) -> list[Column]:
    return [F.expr(f"count_if({condition})").alias(name) for name, condition in conditions.items()]


def counting() -> list[Column]:
    """Total and the five listed categories, as aggregates."""
    return [F.count(F.lit(1)).alias("total_findings"),
            *_counts({name: f"category = {lit(category)}" for name, category in COUNTED.items()})]


def statistics(findings: DataFrame, by=()) -> DataFrame:
    """Total and the five listed categories."""
    return findings.groupBy(*by).agg(*counting())


def summary(findings: DataFrame) -> DataFrame:
    """Findings per listed category."""
    return findings.where(F.col("category").isin(list(COUNTED.values()))).groupBy("category").agg(
        F.count("*").alias("findings"))


def severity_histogram(findings: DataFrame, by=()) -> DataFrame:
    return findings.groupBy(*by).agg(F.count("*").alias("total"), *_counts(LEVELS))


def severity_shares(findings: DataFrame) -> DataFrame:
    """Each level's percentage of all findings, 0 where there are none."""
    return severity_histogram(findings).select(*[
        F.expr(f"coalesce(try_divide({name} * 100.0D, total), 0.0D)").alias(f"{name}_share") for name in LEVELS])


def verdict(findings: DataFrame, by=()) -> DataFrame:
    """The overall risk: ``risk`` as the console words it, ``report_risk`` as the report does."""
    words = " ".join(f"WHEN risk = {lit(risk)} THEN {lit(text)}" for risk, text in V.VERDICTS.items())
    return severity_histogram(findings, by).select(
        *by, "total", "critical", "high",
        F.expr("CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 THEN 'high' WHEN total > 0 THEN 'low' "
               "ELSE 'clean' END").alias("risk"),
        F.expr("CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 THEN 'high' WHEN total > 0 THEN 'medium' "
               "ELSE 'low' END").alias("report_risk")).selectExpr("*", f"CASE {words} END AS wording")


def page_verdicts(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """A verdict for every page, those without findings included.

    Findings are counted per page before the join, so no page's findings meet in one task.
    """
    counted = severity_histogram(findings, ["page_id", "location"]).withColumnsRenamed(
        {"page_id": "_page", "location": "_location"})
    levels = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("total", *LEVELS)]
    same = F.col("page_id").eqNullSafe(F.col("_page")) & F.col("location").eqNullSafe(F.col("_location"))
    return pages.select("page_id", "location").join(counted, same, "left").select(
        "page_id", "location", *levels).withColumn("risk", F.expr(
            "CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 THEN 'high' WHEN total > 0 THEN 'low' "
            "ELSE 'clean' END"))


def section(category: str = "category") -> Column:
    """The report section of a category."""
    return F.expr(f"IF({category} IN ({', '.join(lit(c) for c in V.SECTIONS if c != 'other')}), {category}, 'other')")


def sections(findings: DataFrame) -> DataFrame:
    """Findings and highest severity of each report section."""
    return findings.groupBy(section().alias("section")).agg(
        F.count("*").alias("findings"), F.max("severity").alias("max_severity"))


def counters(scanned: DataFrame, errors: DataFrame) -> DataFrame:
    """How much was scanned: files, URLs, both, and errors."""
    both = scanned.select("kind").unionByName(errors.select(F.lit("error").alias("kind")))
    return both.agg(F.expr("count_if(kind = 'file')").alias("scanned_files"),
                    F.expr("count_if(kind = 'url')").alias("scanned_urls"),
                    F.expr("count_if(kind IN ('file', 'url'))").alias("total_scanned"),
                    F.expr("count_if(kind = 'error')").alias("errors"))


def ranked_keywords(findings: DataFrame) -> DataFrame:
    """Keyword findings with their ``rank`` on the page: most severe first, then as they stand.

    Bounded by the text of one page, so a window per page is safe.
    """
    order = Window.partitionBy("page_id", "location").orderBy(F.desc("severity"), "pos_start", "evidence")
    return findings.where("category = 'keyword_match'").withColumn("rank", F.row_number().over(order))
