"""Keyword lists and user-defined rules."""

import csv
import re
from functools import cache
from importlib import resources

from pyspark.sql import DataFrame, SparkSession

from pagescan.functions.folding import folded
from pagescan.functions.text import lits
from pagescan.operators.catalog import Rule
from pagescan.rules import values as V


@cache
def built_in_keywords() -> tuple:
    """The packaged (keyword, category, weight) rows, in list order."""
    text = (resources.files("pagescan.rules") / "keywords.csv").read_text("utf-8")
    rows = csv.reader(line for line in text.splitlines() if not line.startswith("#"))
    return tuple((keyword, category, int(weight)) for keyword, category, weight in rows)


def clean_keywords(rows: DataFrame) -> DataFrame:
    """Raw string columns keyword, category, weight as a keyword table.

    Comment lines, blank keywords and rows without a third column (NULL) go; unknown categories
    become ``other``; weights are held between 1 and 10, blank and unreadable ones are 5.
    """
    return (rows.where("weight IS NOT NULL AND trim(keyword) != '' AND NOT startswith(trim(keyword), '#')")
            .selectExpr(
                "trim(keyword) AS keyword",
                f"IF(trim(category) IN ({lits(V.KEYWORD_CATEGORIES)}), trim(category), 'other') AS category",
                "coalesce(CASE WHEN rlike(trim(weight), '^[+-]?[0-9]+$') THEN greatest(1, least(10, "
                "CAST(CAST(trim(weight) AS DECIMAL(38, 0)) AS DECIMAL(38, 0)))) END, 5) AS weight")
            .selectExpr("keyword", "category", "CAST(weight AS INT) AS weight"))


def load_keywords(spark: SparkSession, path: str | None = None) -> list[dict]:
    """Keywords ready for matching, from a CSV file or, without one, the packaged list.

    A file that is missing or holds nothing falls back to the packaged list.  Of equal
    keywords the first one listed counts.
    """
    rows = ()
    if path is not None:
        try:
            # A blank third column is read as the empty text, a missing one as NULL.
            raw = spark.read.csv(path, schema="keyword STRING, category STRING, weight STRING", nullValue="\x00",
                                 emptyValue="")
            rows = [tuple(r) for r in clean_keywords(raw).collect()]
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    return keyword_table(rows or built_in_keywords())


def keyword_table(rows) -> list[dict]:
    """(keyword, category, weight) rows as the matcher takes them; ASCII words of one or two letters must stand alone."""
    unique = {}
    for keyword, category, weight in rows:
        unique.setdefault(keyword, (category, weight))
    return [{"keyword": keyword, "folded": folded(keyword), "whole": bool(re.fullmatch("[A-Za-z]{1,2}", keyword)),
             "category_name": V.KEYWORD_CATEGORIES.get(category, V.KEYWORD_CATEGORIES["other"]),
             "weight": weight} for keyword, (category, weight) in unique.items()]


def clean_custom_rules(rows: DataFrame) -> DataFrame:
    """Columns of user rules with defaults put in and severities held between 1 and 10; a row whose
    severity is no number is skipped."""
    usable = "rule_id IS NOT NULL AND pattern IS NOT NULL AND (severity IS NULL OR try_cast(severity AS INT) IS NOT NULL)"
    return rows.where(usable).selectExpr(
        "rule_id", "pattern", "coalesce(flags, '') AS flags",
        "greatest(1, least(10, coalesce(try_cast(severity AS INT), 5))) AS severity",
        "coalesce(category, 'suspicious_pattern') AS category", "coalesce(source_type, 'text') AS source_type",
        "coalesce(description, '') AS description")


def load_custom_rules(path: str, spark: SparkSession | None = None) -> list[Rule]:
    """User rules from a YAML file; entries that cannot be used are skipped.

    With a session the file is read by Spark, from any storage it knows.
    """
    import yaml
    try:
        if spark is not None:
            data = yaml.safe_load(spark.read.text(path, wholetext=True).first()[0])
        else:
            with open(path, encoding="utf-8") as file:
                data = yaml.safe_load(file)
    except (OSError, yaml.YAMLError):
        return []
    return custom_rules(data.get("rules", ()) if isinstance(data, dict) else ())


def custom_rules(entries) -> list[Rule]:
    """User rules from dictionaries with rule_id and pattern, the rest optional."""
    rules = []
    for entry in entries:
        try:
            pattern, flags = str(entry["pattern"]), str(entry.get("flags", "")).lower()
            re.compile(pattern)
            rules.append(Rule(
                str(entry["rule_id"]), pattern, "".join(f for f in "ism" if f in flags), kind="custom",
                severity=max(1, min(10, int(entry.get("severity", 5)))),
                category=str(entry.get("category", "suspicious_pattern")),
                source_type=str(entry.get("source_type", "text")), margin=80, cut=200,
                metadata={"description": str(entry.get("description", "")), "rule_file": "custom"}))
        except (re.error, KeyError, TypeError, ValueError, AttributeError):
            continue
    return rules
