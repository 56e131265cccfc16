"""The text rules as data: what to look for, and how a match becomes a finding."""

from dataclasses import dataclass, field

from pagescan.functions.dialect import to_java
from pagescan.rules import values as V

#: The start of a word, for an engine whose own word boundary knows ASCII only.
WORD_START = r"^|\W"


@dataclass(frozen=True)
class Rule:
    """One pattern.  ``guards`` are literals of which one must occur before it is tried
    (in whatever case); ``kind`` says how its matches are
    turned into findings; ``at_least`` and ``until`` make one row per page of them;
    ``upto`` is the text every match ends with (``tail`` a pattern for it): what follows its
    last occurrence is not tried;
    ``lead`` says that group 1 is text before the match proper.  ``linear`` patterns have open repetitions
    that hostile pages could abuse, and are matched by ``functions.linear``; ``before`` is what must
    stand ahead of such a match."""

    key: str
    pattern: str
    flags: str = ""
    guards: tuple = ()
    kind: str = "plain"
    severity: int = 3
    category: str = "suspicious_pattern"
    source_type: str = "html"
    margin: int = 50
    groups: tuple = ()
    at_least: int = 1
    until: int | None = None
    cut: int | None = None
    evidence: str | None = None
    placed: bool = True
    metadata: dict = field(default_factory=dict)
    requires: str | None = None
    upto: str | None = None
    tail: str | None = None
    lead: bool = False
    java: str | None = None
    linear: bool = False
    before: str = ""

    def regex(self) -> str:
        return self.java or to_java(self.pattern, self.flags)


def _html():
    for name, pattern, severity, description, guards in V.HTML_PATTERNS:
        before = WORD_START if name == "obfuscated_attributes" else ""
        yield Rule(f"html:pattern:{name}", pattern.removeprefix(r"\b") if before else pattern, "i", tuple(guards),
                   severity=severity, linear=name in ("data_uri", "remote_iframe", "obfuscated_attributes"),
                   before=before, metadata={"pattern": name, "description": description})
    yield Rule("html:hidden_element", V.HTML_HIDDEN, "i", ("display", "visibility"), severity=2,
               linear=True, category="hidden_element", metadata={"description": V.HTML_HIDDEN_DESCRIPTION})
    yield Rule("html:comment", V.HTML_COMMENT, "s", ("<!--",), kind="html_comment", groups=(1,), upto="-->")
    yield Rule("html:meta:refresh", V.HTML_META, "i", ("<meta",), kind="meta", groups=(2,), placed=False, linear=True,
               category="suspicious_url", source_type="meta")


def _js():
    for name, severity in V.JS_HIGH_RISK.items():
        yield Rule(f"js:high_risk:{name}", rf"\b{name}\s*\(", "", (name,), kind="js_call", severity=severity,
                   margin=80, category="js_issue", source_type="js", metadata={"function": name})
    for name, pattern, description, guards in V.JS_OBFUSCATION:
        yield Rule(f"js:obfuscation:{name}", pattern, "", tuple(guards), kind="js_count", margin=80,
                   category="js_issue", source_type="js", at_least=5, until=0, placed=False,
                   lead=name == "array_join", groups=(1,) if name == "array_join" else (), metadata={"pattern": name, "description": description})
    for name, pattern, severity, description, guards in V.JS_PATTERNS:
        yield Rule(f"js:pattern:{name}", pattern, "", tuple(guards), severity=severity, margin=80, cut=200,
                   linear=name in ("self_executing", "conditional_eval", "try_catch_eval", "hidden_eval"),
                   category="js_issue", source_type="js",
                   metadata={"pattern": name, "description": description})
    yield Rule("js:line_comment", V.LINE_COMMENT, "", ("//",), kind="line_comment", groups=(1,),
               category="js_issue", source_type="comments")


def _css():
    for prop, values in V.CSS_HIDING_VALUES.items():
        # One pattern per property: the longest value that fits holds the shorter ones.
        fitting = "|".join("".join("\\" + c if c in "()." else c for c in v)
                           for v in sorted(values, key=len, reverse=True))
        yield Rule(f"css:hiding:{prop}", rf"{prop}\s*:\s*({fitting})", "i", (prop,), kind="css_value",
                   groups=(1,), category="hidden_element", source_type="css", metadata={"property": prop})
    yield Rule("css:hiding:absolute_pos", V.CSS_ABSOLUTE, "is", ("{",), kind="css_absolute", linear=True,
               category="hidden_element", source_type="css", requires=V.CSS_OFFSET)
    for name, pattern, severity, description, guards in V.CSS_SELECTORS:
        yield Rule(f"css:selector:{name}", pattern, "", tuple(guards), severity=severity, category="css_issue",
                   linear=name == "attr_js", source_type="css", metadata={"description": description})
    for name, pattern, prop, guards in V.CSS_PROPERTIES:
        yield Rule(f"css:property:{name}", pattern, "i", tuple(guards), category="css_issue",
                   linear=name != "bg_image", source_type="css", metadata={"property": prop})
    yield Rule("css:import:external", V.CSS_IMPORT, "i", ("@import",), kind="css_import", margin=40,
               groups=(1, 2), category="css_issue", source_type="css")
    # Counted in the lower-cased text, which knows ASCII case only for these letters.
    yield Rule("css:import:excessive", "@import", java="(?i)@import", guards=("@import",), kind="css_count",
               at_least=11, until=0, placed=False, category="css_issue", source_type="css",
               evidence=V.EVIDENCE_IMPORTS)
    yield Rule("css:obfuscation:long_names", V.CSS_LONG_NAMES, "", (".", "#"), kind="css_count", at_least=5,
               until=0, placed=False, category="css_issue", source_type="css", evidence=V.EVIDENCE_LONG_NAMES)
    yield Rule("css:obfuscation:control_chars", V.CSS_CONTROL, "", (), kind="css_count", at_least=11,
               until=0, placed=False, category="css_issue", source_type="css", evidence=V.EVIDENCE_CONTROL)


def _hiding():
    def rule(name, pattern, flags="i", guards=(), **more):
        technique = {"technique": V.TECHNIQUES[name]}
        defaults = dict(severity=7, category="hidden_element", source_type="css", placed=False,
                        metadata=technique)
        return Rule(f"hiding:{name}", pattern, flags, guards, **{**defaults, **more})

    yield rule("zero_width", V.ZERO_WIDTH, "", (), kind="zero_width", until=2**31 - 1, source_type="text")
    yield rule("whitespace", V.WHITESPACE_RUN, "", (), kind="whitespace", severity=4, source_type="text")
    yield rule("color_match", V.TEXT_COLOR, guards=("background-color",), kind="color")
    yield rule("absolute_pos", V.HIDING_POSITION, "is", ("position",), kind="position", groups=(1, 2),
               tail=V.HIDING_POSITION_TAIL)
    yield rule("font_size", V.HIDING_FONT, guards=("font-size",), kind="font", groups=(1,))
    yield rule("text_indent", V.HIDING_INDENT, guards=("text-indent",), kind="indent", groups=(1,))
    yield rule("opacity", V.HIDING_OPACITY, guards=("opacity",))
    yield rule("visibility", V.HIDING_VISIBILITY, guards=("visibility",), evidence="visibility: hidden")
    yield rule("display_none", V.HIDING_DISPLAY, guards=("display",), evidence="display: none")
    yield rule("nested", V.HIDING_NESTED, guards=("<div", "<span", "<p", "<a"), severity=4,
               linear=True, source_type="html", margin=30, evidence=V.EVIDENCE_NESTED)
    yield rule("entities", V.NUMERIC_ENTITY, guards=("&#",), kind="entities", at_least=11, until=5,
               severity=4, source_type="html", margin=20)


# Block comments feed both the script and the style rules, so they are cut out once.
BLOCK_COMMENT = Rule("block_comment", V.BLOCK_COMMENT, "s", ("/*",), kind="block_comment", groups=(1,),
                     source_type="comments", upto="*/")
KEYWORD = Rule("keyword", "", kind="keyword", category="keyword_match", source_type="text", margin=60)
URL = Rule("url", "", kind="url", category="suspicious_url")
#: The same addresses, but only as links of a page, not as addresses in scripts and styles.
LINK = Rule("link", "", kind="link", category="suspicious_url")
# Not patterns, but looked for in the same pass over the pages.
ELEMENT = Rule("html:dom", "", kind="element")
ENTROPY = Rule("js:entropy", "", kind="entropy", category="js_issue", source_type="js")
# Not a rule: what could not be judged, where that is asked for.
ERROR = Rule("#error", "", kind="error", category="error", source_type="", severity=0)

HTML, JS, CSS, HIDING = tuple(_html()), tuple(_js()), tuple(_css()), tuple(_hiding())
