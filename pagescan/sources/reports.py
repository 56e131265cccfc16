"""Report data sets and their writers."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pagescan.functions.text import lit
from pagescan.operators.ranking import numbered
from pagescan.operators.rollups import counting, section
from pagescan.rules import values as V
from pagescan.sources.reporting import FORMAT, Reporter, register, write_report


_BY_LOCATION = ("location", "page_id", "-severity", "rule_id", "pos_start", "evidence", "context")
_BY_SEVERITY = ("-severity", "location", "page_id", "rule_id", "pos_start", "evidence", "context")


def formula_guard(value: str) -> str:
    """SQL: spreadsheet programs must not take a value for a formula."""
    text = f"coalesce({value}, '')"
    return f"IF(substring({text}, 1, 1) IN ('=', '+', '-', '@'), concat('\\'', {text}), {text})"


def csv_rows(findings: DataFrame) -> DataFrame:
    """The eight columns of the CSV report, numbered."""
    shaped = findings.select(
        "rule_id", "category", "severity", "source_type", "location", *[F.expr(f"left({formula_guard(c)}, 200) AS {c}") for c in ("evidence", "context")],
        "page_id", "pos_start")
    return numbered(shaped, None, *_BY_LOCATION).select(
        "no", "rule_id", "category", "severity", "source_type", "location", "evidence", "context")


def text_rows(findings: DataFrame) -> DataFrame:
    """The entries of the text report: suspicious URLs and keyword matches."""
    listed = findings.where("category IN ('suspicious_url', 'keyword_match')").selectExpr(
        "category", "severity", "location", "evidence", "context", "array_join(reasons, ', ') AS reasons",
        "metadata['category'] AS keyword_category", "metadata['weight'] AS weight", "page_id", "rule_id", "pos_start")
    return numbered(listed, "category", *_BY_LOCATION).selectExpr(
        "category AS section", "no", "evidence", "location", "concat(severity, '/10') AS severity",
        "reasons", "left(context, 150) AS context", "keyword_category", "weight")


def section_rows(findings: DataFrame) -> DataFrame:
    """The HTML report's tables: six sections, each numbered by falling severity, cut for display."""
    cuts = {"suspicious_url": (200, 300), "keyword_match": (200, 250)}
    evidence, context = (
        "CASE section " + " ".join(f"WHEN {lit(s)} THEN left({col}, {cut[i]})" for s, cut in cuts.items())
        + f" ELSE left({col}, {rest}) END AS {col}" for i, (col, rest) in enumerate((("evidence", 120), ("context", 250))))
    titles = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in V.SECTIONS.items())
    shaped = findings.select(section().alias("section"), "rule_id", "severity", "location", "evidence", "context", "page_id", "pos_start")
    return numbered(shaped, "section", *_BY_SEVERITY).selectExpr(
        "section", f"CASE section {titles} END AS title", "no", "rule_id", "severity", "location",
        evidence, context)


class CsvReporter(Reporter):
    """One line for each finding under a header with a byte-order mark, as spreadsheets want it."""

    ending = ".csv"
    header = "\ufeff" + ",".join(V.CSV_COLUMNS)

    def lines(self, findings: DataFrame) -> DataFrame:
        rows = csv_rows(findings)
        return rows.select("no", F.to_csv(F.struct(*rows.columns), {
            "escape": '"', "quoteAll": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}).alias("line"))


class TextReporter(Reporter):
    """One entry for each listed finding, section after section."""

    def lines(self, findings: DataFrame) -> DataFrame:
        entry = ("concat_ws('\\n', concat('[', no, '] ', evidence), concat('    ', location), "
                 "concat('    ', severity), IF(reasons = '', NULL, concat('    ', reasons)), "
                 "concat('    ', keyword_category, ' ', weight), "
                 "IF(context = '', NULL, concat('    ', context))) AS line")
        # Suspicious URLs before keywords.
        return text_rows(findings).selectExpr("named_struct('s', IF(section = 'suspicious_url', 0, 1), 'no', no) AS no", entry)


class JsonReporter(Reporter):
    """One object for each finding, without its place."""

    ending = ".json"

    def lines(self, findings: DataFrame) -> DataFrame:
        shown = findings.drop("pos_start", "pos_end", "page_id")
        return shown.select(F.struct("location", "rule_id", "evidence").alias("no"), F.to_json(F.struct(*shown.columns)).alias("line"))


REPORTERS = {"csv": CsvReporter(), "text": TextReporter(), "json": JsonReporter()}


def write_csv(findings: DataFrame, path: str) -> None:
    write_report(findings, path, REPORTERS["csv"])


def write_text(findings: DataFrame, path: str) -> None:
    write_report(findings, path, REPORTERS["text"])


def write_json(findings: DataFrame, path: str, **about) -> None:
    """Findings as JSON lines, and the report header with the statistics beside them.

    The statistics are counted while the findings are written, so those are evaluated once.
    """
    spark, seen = findings.sparkSession, Observation()
    counted = findings.observe(seen, *counting())
    # Not sorted: a sort evaluates its input twice, and lines of JSON need no order.
    rows = counted.drop("pos_start", "pos_end", "page_id")
    register(spark)
    rows.select(F.to_json(F.struct(*rows.columns)).alias("line")).write.format(FORMAT).option("ending", ".json").mode(
        "overwrite").save(f"{path}/findings")
    header = F.struct(*[F.lit(str(v)).alias(k) for k, v in about.items()], F.current_timestamp().alias("generated_at"))
    totals = F.struct(*[F.lit(v).alias(k) for k, v in seen.get.items()])
    spark.range(1).select(F.to_json(F.struct(header.alias("report"), totals.alias("statistics"))).alias("line")).write.format(
        FORMAT).option("ending", ".json").mode("overwrite").save(f"{path}/summary")
