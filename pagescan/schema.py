"""The one record every rule yields."""

from pyspark.sql import DataFrame

from pagescan.functions.text import lit

FIELDS = {"rule_id": "STRING", "severity": "INT", "category": "STRING", "source_type": "STRING",
          "evidence": "STRING", "context": "STRING", "pos_start": "INT", "pos_end": "INT",
          "reasons": "ARRAY<STRING>", "metadata": "MAP<STRING, STRING>"}
FINDINGS = "page_id BIGINT, location STRING, " + ", ".join(f"{n} {t}" for n, t in FIELDS.items())
PAGES = "page_id BIGINT, location STRING, content STRING"


def text_map(values: dict) -> str:
    """A string map of SQL values."""
    if not values:
        return "CAST(map() AS MAP<STRING, STRING>)"
    return "map(" + ", ".join(f"{lit(k)}, CAST({v} AS STRING)" for k, v in values.items()) + ")"


def finding(rule_id: str, severity, category: str, source_type: str, evidence: str, context: str = "''",
            start="0", stop="0", reasons: str = "array()", metadata: dict | str = "map()") -> str:
    """A finding struct; all arguments are SQL text."""
    metadata = text_map(metadata) if isinstance(metadata, dict) else metadata
    values = [rule_id, severity, category, source_type, evidence, context, start, stop, reasons, metadata]
    return "named_struct(" + ", ".join(
        f"'{name}', CAST({value} AS {kind})" for (name, kind), value in zip(FIELDS.items(), values)) + ")"


def to_findings(df: DataFrame, findings: str) -> DataFrame:
    """One row per element of an array of findings."""
    return df.selectExpr("page_id", "location", f"inline({findings})")
