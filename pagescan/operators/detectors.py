"""Detectors of a user's own that look at one page at a time, as a table function.

A detector is an object with ``detect(content, location)`` that yields dictionaries with fields of a finding.  The table function
is called laterally for each page; a detector that fails on a page gives an error row for that page, and
the other detectors and pages go on.
"""

import json
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescan.functions.text import valid
from pagescan.schema import FIELDS

_RETURNS = ", ".join(f"{n} {t}" for n, t in FIELDS.items())
_DEFAULTS = {"severity": 5, "category": "suspicious_pattern", "source_type": "text", "evidence": "", "context": "",
             "pos_start": 0, "pos_end": 0, "reasons": [], "metadata": {}}


def _row(found: dict) -> tuple:
    """A finding with defaults put in; severities are held between 1 and 10, other values turned into text."""
    full = _DEFAULTS | {k: v for k, v in found.items() if v is not None}
    metadata = {str(k): v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in full["metadata"].items()}
    return (str(full["rule_id"]), max(1, min(10, int(full["severity"]))), str(full["category"]), str(full["source_type"]),
            str(full["evidence"]), str(full["context"]), int(full["pos_start"]), int(full["pos_end"]),
            [str(r) for r in full["reasons"]], metadata)


def page_detector(*detectors):
    """A function from pages to rows as ``scan`` takes it for ``extra``; errors come as rows, see ``scan``."""
    def found(pages: DataFrame, errors: bool = False) -> DataFrame:
        class Detect:
            def eval(self, content: str, location: str):
                for detector in detectors:
                    try:
                        rows = [_row(f) for f in detector.detect(content or "", location)]
                    except Exception as error:  # this detector, on this page
                        rows = [("#detector", 0, "error", "", f"{type(detector).__name__}: {type(error).__name__}: {error}", "", 0, 0, [], {})]
                    yield from rows

        call = F.udtf(Detect, returnType=_RETURNS)
        rows = pages.selectExpr("page_id", valid("location"), valid("content")).alias("_page").lateralJoin(
            call(F.col("_page.content").outer(), F.col("_page.location").outer()).alias("_found")).select(
            "page_id", "location", *FIELDS)
        return rows if errors else rows.where("NOT startswith(rule_id, '#')")

    found.errors = True
    return found


cloudpickle.register_pickle_by_value(sys.modules[__name__])
