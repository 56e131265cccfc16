"""The whole scan: which rules a mode runs, over pages, to findings, errors and counters."""

from functools import reduce

from pyspark.sql import DataFrame

from pagescan.functions.text import lit
from pagescan.operators import catalog as C
from pagescan.operators.custom import as_custom
from pagescan.operators.dom import dom_findings
from pagescan.operators.textrules import entropy_findings, text_findings
from pagescan.rules.loaders import keyword_table, built_in_keywords

MODES = {"fast": ("keyword", "html"),
         "standard": ("keyword", "html", "js", "css", "hiding"),
         "deep": ("keyword", "html", "js", "css", "hiding")}


def union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _rules(mode: str, rules) -> list:
    """The catalog rules of a mode, and the user's."""
    parts = MODES[mode]
    if "js" not in parts:
        return [C.KEYWORD, *C.HTML, C.LINK, C.ELEMENT, *rules]
    return [C.KEYWORD, *C.HTML, C.URL, C.ELEMENT, *C.JS, *C.CSS, *C.HIDING, C.BLOCK_COMMENT, C.ENTROPY, *rules]


def scan(pages: DataFrame, mode: str = "deep", keywords=None, rules=(), extra=(), errors: bool = False) -> DataFrame:
    """Findings over ``pages(page_id, location, content)``.

    ``keywords`` replaces the packaged list (see ``load_keywords``), ``rules`` are user
    rules (``load_custom_rules``), ``extra`` further detectors: functions from pages to
    findings.  All rules share one pass over the pages; further detectors
    have their own.  With ``errors`` the rows hold what failed as well, see ``text_findings``.
    """
    keywords = keyword_table(built_in_keywords()) if keywords is None else keywords
    found = text_findings(pages, _rules(mode, as_custom(rules)), keywords, errors)
    return union([found, *[detector(pages, errors=True) if errors and getattr(detector, "errors", False) else detector(pages)
                           for detector in extra]])


def detect(pages: DataFrame, detector: str) -> DataFrame:
    """Findings of one detector: keyword, html, js, css or hiding."""
    def texts(rules, prefix, keywords=()):
        return text_findings(pages, rules, keywords).where(f"startswith(rule_id, {lit(prefix)})")

    if detector == "keyword":
        return texts([C.KEYWORD], "keyword:", keyword_table(built_in_keywords()))
    if detector == "html":
        return union([texts([*C.HTML, C.URL], "html:"), dom_findings(pages)])
    if detector == "js":
        return union([texts([*C.JS, C.BLOCK_COMMENT, C.URL], "js:"), entropy_findings(pages)])
    if detector == "css":
        return texts([*C.CSS, C.BLOCK_COMMENT, C.URL], "css:")
    return texts(C.HIDING, "hiding:")


def errors_of(rows: DataFrame) -> DataFrame:
    """``location, stage, message`` of the rows of a scan ``with errors`` that say what failed."""
    return rows.where("startswith(rule_id, '#')").selectExpr("location", "substring(rule_id, 2) AS stage", "evidence AS message")


def findings_of(rows: DataFrame) -> DataFrame:
    """The findings among the rows of a scan with errors."""
    return rows.where("NOT startswith(rule_id, '#')")


def scan_errors(pages: DataFrame, rules=()) -> DataFrame:
    """What could not be judged: element trees that failed, URLs with an impossible port, user rules
    that failed on a page, and pages on which anything else failed.

    Only the failing part of a page is lost; its other findings stay.
    """
    return errors_of(text_findings(pages, [C.LINK, C.ELEMENT, *as_custom(rules)], errors=True))
