"""Rules on rendered elements: what a browser saw, given as a table.

The browser itself is not part of this package.  ``RENDERED`` is one row per element with
its computed style and box; ``href``/``src`` are set on links and frames, ``links`` holds
the targets of all links inside the element.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescan.functions.text import each, let, lit, struct, when
from pagescan.functions.urls import url_risk
from pagescan.rules import values as V
from pagescan.schema import finding, to_findings

RENDERED = ("page_id BIGINT, location STRING, tag STRING, text STRING, href STRING, src STRING, display STRING, "
            "visibility STRING, opacity STRING, position STRING, left_px INT, top_px INT, width DOUBLE, "
            "height DOUBLE, font_px INT, links ARRAY<STRING>")


def _risky(rule, address, context, **metadata) -> str:
    return let(lambda v: when(f"{v}.risk.risk_level > 0", finding(
        lit(rule), f"{v}.risk.risk_level", "'suspicious_url'", "'dynamic'", address, context,
        reasons=f"{v}.risk.reasons", metadata=metadata)), risk=url_risk(address))


def rendered_findings(rendered: DataFrame) -> DataFrame:
    """Risky links and frames, hidden elements, and the links inside those."""
    link = when("lower(tag) = 'a' AND href != ''", _risky(
        "headless:dynamic_link", "href", f"concat({lit(V.RENDERED_LINK)}, left(trim(text), 100))", element="'a'"))
    frame = when("lower(tag) = 'iframe' AND src != ''", _risky(
        "headless:iframe", "src", "concat('iframe src: ', src)"))
    off_screen = "(position = 'absolute' AND (left_px < -1000 OR top_px < -1000))"
    unseen = ("(display = 'none' OR visibility = 'hidden' OR opacity = '0' OR width <= 1 OR height <= 1 "
              "OR font_px <= 0)")
    # Unknown style values hide nothing.
    facts = struct(
        off=f"coalesce({off_screen}, false)", hidden=f"coalesce({off_screen}, false) OR coalesce({unseen}, false)",
        shown="left(trim(coalesce(text, '')), 200)", links="coalesce(filter(links, l -> l != ''), array())")
    rows = rendered.selectExpr("*", f"{facts} AS e")
    holds = "e.hidden AND (size(e.links) > 0 OR e.shown != '')"
    severity, technique = "IF(size(e.links) > 0, 8, 6)", "IF(e.off, 'off_screen', 'visibility')"
    element = when(holds, finding(
        "'headless:hidden_element'", severity, "'hidden_element'", "'dynamic'",
        "concat('<', upper(tag), '>: ', e.shown)", "e.shown",
        metadata={"technique": technique, "tag": "upper(tag)", "links": "array_join(e.links, ' ')"}))
    first, last = V.RENDERED_REASON
    inside = each("transform", "e.links", lambda l: let(lambda v: finding(
        "'headless:hidden_link'", f"greatest({severity}, {v}.risk.risk_level)", "'suspicious_url'", "'dynamic'", l,
        f"concat({lit(V.RENDERED_HIDDEN_LINK)}, {l})",
        reasons=f"array(concat({lit(first)}, {technique}, {lit(last)}))"), risk=url_risk(l)))
    return to_findings(rows, f"concat(array_compact(array({link}, {frame}, {element})), "
                             f"IF({holds}, {inside}, array()))")


def cloaked_findings(seen_as: DataFrame, seen_by: DataFrame) -> DataFrame:
    """Findings of one snapshot of the pages that the other snapshot of them lacks.

    Each (location, rule, evidence) gets a bit for each snapshot that shows it, put together in one aggregation of narrow
    rows before the shuffle; so a location with very many snapshots, or evidence that is the same everywhere, is one row
    for each task.  Only the keys that lack the second bit meet the findings again; NULL locations are values like others.
    """
    keys = ["location", "rule_id", "evidence"]
    bits = seen_as.select(*keys, F.lit(1).alias("bit")).unionByName(seen_by.select(*keys, F.lit(2).alias("bit")))
    lacking = bits.groupBy(*keys).agg(F.expr("bit_or(bit) AS bits")).where("bits = 1").select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return seen_as.join(lacking, same[0] & same[1] & same[2], "left_semi").select(*seen_as.columns)
