"""Rules on the element tree of a page.

``elements`` parses pages (Python, map-side) into one row per element, with its place in the page.  The
rules run on narrower rows of the elements they can look at, from pages on which one can fire.
"""

import re
from bisect import bisect_left
from html import escape, unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from pagescan.functions import urls as U
from pagescan.functions.linear import Fact
from pagescan.functions.text import contains_any, fold, has_match, let, lit, only, valid, when
from pagescan.rules import values as V
from pagescan.schema import finding, to_findings

#: All elements: ``begin`` and ``stop`` are offsets into the page's content, ``text`` is the element's own
#: text without that of elements inside it.
ELEMENTS = ("page_id BIGINT, location STRING, elem_no INT, tag STRING, attrs MAP<STRING, STRING>, "
            "text STRING, begin INT, stop INT, form_no INT, field_types ARRAY<STRING>")
#: What the rules look at: ``text`` is a script's code or the beginning of a link's whole text, ``bait``
#: says whether that text holds a bait word, ``outer_html`` is what findings can show of the source.
_LOOKED_AT = ("page_id BIGINT, location STRING, elem_no INT, tag STRING, attrs MAP<STRING, STRING>, "
              "text STRING, bait BOOLEAN, outer_html STRING, form_no INT, field_types ARRAY<STRING>")
# Findings show 500 characters of an element and 100 of a link's text at most.
SHOWN, _SHOWN_TEXT = 500, 100

# Elements without content, and which start tag ends an open element.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_ENDED_BY = {
    "a": {"a"}, "form": {"form"}, "li": {"li"}, "option": {"option"}, "tr": {"tr"},
    "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
    "p": {"p", "div", "ul", "ol", "dl", "li", "table", "tr", "td", "th", "pre", "hr", "center", "address",
          "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"},
}
_ALWAYS = {"script", "iframe", "form", "a", "input"}
_MARKS = {"style", "hidden", "class"}
_USED = {"src", "integrity", "href", "style", "width", "height", "sandbox", "aria-hidden", "action", "type",
         "name", "value", "hidden", "class"}


# Start tags with their attributes, end tags, and everything else in angle brackets.  All
# repetitions are possessive, so broken markup cannot make the search go back.
_MARKUP = re.compile(r"""
    <!--(?P<comment>.*?)(?:--!?>|\Z)
  | <(?P<start>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+|=)*+)(?:>|\Z)
  | </(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)
  | <[!?/][^>]*+(?:>|\Z)""", re.S | re.X)
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+""")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style", "textarea", "title")}


def _attributes(source):
    values = {}
    for name, value in _ATTRIBUTE.findall(source):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        values.setdefault(name.lower(), unescape(value) if "&" in value else value)
    if "class" in values:
        values["class"] = " ".join(values["class"].split())
    return values


_BAIT = re.compile("(?=" + "|".join(map(re.escape, V.BAIT_WORDS)) + ")")
_LONGEST_BAIT = max(map(len, V.BAIT_WORDS))
_UNBLANK = re.compile("[^ ]+")


class _Page:
    """One page's elements; ``parts`` are (kind, value) pieces of its normalised source.

    ``texts`` are the pieces of its text, and a link knows its stretch of them, so that links
    left open inside one another cost no more than others.
    """

    def __init__(self, text):
        self.rows, self.open, self.parts, self.forms, self.form = [], [], [], 0, None
        self.counts, self.texts, self.length = {}, [], 0
        place = 0
        while True:
            found = _MARKUP.search(text, place)
            self._text(text[place:found.start() if found else len(text)])
            if not found:
                break
            place = found.end()
            kind = found.lastgroup
            if place == len(text) and text[-1] != ">" and kind != "comment":
                break  # a tag that never ends is none, and takes the rest of the page with it
            if kind == "attrs":
                tag = found["start"].lower()
                row = self._start(tag, found["attrs"], found.start(), place)
                if tag in _RAW_END:
                    end = _RAW_END[tag].search(text, place)
                    stop = end.start() if end else len(text)
                    code = tag in ("script", "style")
                    if stop > place:
                        self._part("code" if code else "text", text[place:stop])
                        row["own"].append(text[place:stop] if code else unescape(text[place:stop]))
                    place = stop
            elif kind == "end":
                self._end(found["end"].lower(), found.start(), place)
            else:
                self.parts.append(("markup", found.group(0)))
        while self.open:
            self._close(len(text))

    def _part(self, kind, value):
        self.parts.append((kind, value))
        if kind == "text":
            self.texts.append(unescape(value))
            self.length += len(self.texts[-1])

    def _text(self, text):
        if text:
            self._part("text", text)
            if self.open:
                self.open[-1]["own"].append(self.texts[-1])

    def _start(self, tag, source, begin, stop):
        while self.open and tag in _ENDED_BY.get(self.open[-1]["tag"], ()):
            self._close(begin)
        values = _attributes(source) if source else {}
        row = {"tag": tag, "attrs": values, "begin": len(self.parts), "form": self.form, "types": [], "own": [],
               "from": begin, "to": stop, "text": self.length}
        if tag == "form":
            self.forms += 1
            self.form, row["number"] = row, self.forms
        elif tag == "input" and self.form is not None:
            self.form["types"].append(values.get("type", ""))
        self.parts.append(("start", row))
        self.rows.append(row)
        if tag in _VOID:
            row["end"], row["text_end"] = len(self.parts), self.length
        else:
            self.open.append(row)
            self.counts[tag] = self.counts.get(tag, 0) + 1
        return row

    def _close(self, stop):
        row = self.open.pop()
        self.counts[row["tag"]] -= 1
        self.parts.append(("markup", f"</{row['tag']}>"))
        row["end"], row["to"], row["text_end"] = len(self.parts), stop, self.length
        if row is self.form:
            self.form = None

    def _end(self, tag, begin, stop):
        if self.counts.get(tag):
            while self.open[-1]["tag"] != tag:
                self._close(begin)
            self._close(stop)

    def _source(self, row):
        """What is shown of an element: its normalised source up to the longest cut."""
        out, length = [], 0
        for place in range(row["begin"], row["end"]):
            kind, value = self.parts[place]
            if kind == "start":
                tag = value["tag"]
                value = f"<{tag}" + "".join(f" {n}={_quoted(v)}" for n, v in value["attrs"].items()) + (
                    "/>" if tag in _VOID else ">")
            elif kind == "text":
                value = escape(unescape(value), quote=False)
            out.append(value)
            length += len(value)
            if length >= SHOWN:
                break
        return "".join(out)[:SHOWN]

    def _number(self, row):
        form = row if row["tag"] == "form" else row["form"]
        return form and form["number"]

    def all(self):
        for number, row in enumerate(self.rows):
            yield (number, row["tag"], [*row["attrs"].items()], "".join(row["own"]), row["from"], row["to"],
                   self._number(row), row["types"] if row["tag"] == "form" else None)

    def looked_at(self):
        """The rows that a rule can look at."""
        text = "".join(self.texts)
        # Lower-cased letter by letter, where that keeps the length.
        low = text.lower() if len(text.lower()) == len(text) else "".join(
            c.lower() if len(c.lower()) == 1 else c for c in text)
        baits = [m.start() for m in _BAIT.finditer(low)]
        filled = [m.span() for m in _UNBLANK.finditer(text)]
        starts = [a for a, _ in filled]
        rows = [row for row in self.rows if row["tag"] in _ALWAYS or not _MARKS.isdisjoint(row["attrs"])]
        for number, row in enumerate(rows):
            tag, own, bait = row["tag"], None, None
            if tag == "script":
                own = "".join(row["own"])
            elif tag == "a":
                begin, end = row["text"], row["text_end"]
                word = bisect_left(starts, begin)
                if word and filled[word - 1][1] > begin:
                    word -= 1
                first = max(begin, starts[word]) if word < len(starts) and max(begin, starts[word]) < end else end
                own = text[first:min(end, first + _SHOWN_TEXT)]
                place = bisect_left(baits, begin)
                # If the first one is not wholly inside, only those close behind it can be.
                near = baits[place:place + _LONGEST_BAIT + 1]
                bait = bool(near) and (near[0] + _LONGEST_BAIT <= end or any(
                    low.startswith(w, at) and at + len(w) <= end for at in near for w in V.BAIT_WORDS))
            yield (number, tag, [(n, v) for n, v in row["attrs"].items() if n in _USED], own, bait, self._source(row),
                   self._number(row), row["types"] if tag == "form" else None)


def _quoted(value):
    value = escape(value, quote=False)
    if '"' not in value:
        return f'"{value}"'
    return f"'{value}'" if "'" not in value else '"' + value.replace('"', "&quot;") + '"'


_TYPES = {"page_id": pa.int64(), "location": pa.string(), "elem_no": pa.int32(), "tag": pa.string(),
          "attrs": pa.map_(pa.string(), pa.string()), "text": pa.string(), "bait": pa.bool_(), "outer_html": pa.string(),
          "begin": pa.int32(), "stop": pa.int32(), "form_no": pa.int32(), "field_types": pa.list_(pa.string())}
#: Elements after which a batch is sent on.
_ROWS = 5_000


def _parser(columns: str, kind: str):
    schema = pa.schema([(c.split()[0], _TYPES[c.split()[0]]) for c in columns.split(", ") if c.split()[0] in _TYPES])

    def batch_of(rows):
        columns = zip(*rows) if rows else ([] for _ in schema)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(column), field.type) for column, field in zip(columns, schema)], schema=schema)

    def parse(batches):
        rows = []
        for batch in batches:
            for page_id, location, content in zip(*(column.to_pylist() for column in batch.columns)):
                try:
                    found = [(page_id, location, *row) for row in getattr(_Page(content or ""), kind)()]
                except Exception as error:  # one broken page must not stop the scan
                    found = [(page_id, location, -1, "#error", [], str(error)) + (None,) * (len(schema) - 6)]
                for row in found:
                    rows.append(row)
                    if len(rows) >= _ROWS:
                        yield batch_of(rows)
                        rows.clear()
        yield batch_of(rows)

    return parse


# A rule can only fire on a page that holds one of these, or spells it with entities.
_SIGNS = ["<iframe", "<form", "://", "hidden", "hide", "invisible", "sr-only", "d-none", "eval",
          "document.write", "fromcharcode", "&#", "&colon", "&sol", "&period"]


def can_fire(folded: str) -> str:
    return f"({contains_any(folded, _SIGNS)} OR rlike({folded}, 'style[ \\\\t\\\\r\\\\n\\\\f]*='))"


def elements(pages: DataFrame) -> DataFrame:
    """One row per element of every page, in the order of start tags; a page that fails gives one ``#error`` row."""
    return pages.selectExpr("page_id", valid("location"), valid("content")).mapInArrow(_parser(ELEMENTS, "all"), ELEMENTS)


def looked_at(pages: DataFrame) -> DataFrame:
    """The elements that a rule can look at, of pages on which one can fire; ``#error`` rows as above."""
    wanted = pages.selectExpr("page_id", valid("location"), valid("content")).where(f"content != '' AND {can_fire(fold('content'))}")
    return wanted.mapInArrow(_parser(_LOOKED_AT, "looked_at"), _LOOKED_AT)


def _attr(name: str) -> str:
    return f"coalesce(attrs[{lit(name)}], '')"


def _row(name, severity, category, evidence, context, reasons="array()", **metadata):
    return finding(lit(f"html:dom:{name}"), severity, lit(category), "'html'", evidence, context,
                   reasons=reasons, metadata=metadata)


def _described(name, severity, category, evidence, context, **more):
    return _row(name, severity, category, evidence, context, description=lit(V.DOM_DESCRIPTIONS[name]), **more)


def _filled(name: str, *values: str) -> str:
    parts = V.DOM_DESCRIPTIONS[name].split("{}")
    mixed = [x for pair in zip(map(lit, parts), [*values, "''"]) for x in pair]
    return f"concat({', '.join(mixed)})"


_OUTER = {n: f"left(outer_html, {n})" for n in (200, 300, 400, 500)}


def _script():
    src = _attr("src")
    calls = " OR ".join(has_match("coalesce(text, '')", rx, "i") for rx in V.DOM_INLINE_CALLS)
    return only(
        when(f"{U.is_web(src)} AND {U.netloc(src)} != '' AND NOT {U.is_trusted_cdn(src)}", _described(
            "external_script", "4", "suspicious_url", src, _OUTER[300], script_src=src)),
        when(f"{U.is_web(src)} AND {_attr('integrity')} = ''", _described(
            "no_sri", "2", "suspicious_pattern", src, _OUTER[300])),
        when(f"{src} = '' AND ({calls})", _described(
            "suspicious_inline_script", "5", "js_issue", "left(text, 200)", "left(text, 300)")))


def _iframe():
    src, style = _attr("src"), f"lower({_attr('style')})"
    hidden = (f"{contains_any(style, ['display:none', 'visibility:hidden'])} OR (contains({style}, 'width') AND "
              f"contains({style}, 'height') AND contains({style}, '0')) OR {_attr('width')} IN ('0', '1') "
              f"OR {_attr('height')} IN ('0', '1')")
    return only(
        when(U.is_web(src), let(
            lambda v: _described(
                "iframe", f"least(10, 3 + IF({v}.external, 2, 0) + {U.tld_weight(f'{v}.tld')})", "suspicious_url",
                src, _OUTER[300], reasons=U.reasons(
                    ("true", lit(V.DOM_IFRAME_REASON)), (f"{v}.external", lit(V.DOM_IFRAME_REASON_EXTERNAL)),
                    (f"{v}.tld IS NOT NULL", f"concat({lit(V.REASON_TLD)}, {v}.tld)"))),
            tld=U.suspicious_tld(U.netloc(src)),
            external=f"(coalesce(base, '') != '' AND {U.is_external_link(src, 'base')})")),
        when(hidden, _described("hidden_iframe", "7", "hidden_element", _OUTER[200], _OUTER[300], style=style)),
        when(f"{U.is_web(src)} AND {_attr('sandbox')} = ''", _described(
            "no_sandbox", "2", "suspicious_pattern", src, _OUTER[300])))


def _link():
    href, style = _attr("href"), f"lower({_attr('style')})"
    why = {"css": contains_any(style, ["display:none", "visibility:hidden"]),
           "opacity": contains_any(style, ["opacity:0", "opacity: 0"]),
           "font": has_match(style, V.DOM_ZERO_FONT), "offscreen": has_match(style, V.DOM_OFFSCREEN),
           "aria": f"{_attr('aria-hidden')} = 'true'"}
    hiding = U.reasons(*[(condition, lit(V.DOM_LINK_REASONS[key])) for key, condition in why.items()])

    def rows(v):
        external = f"(coalesce(base, '') != '' AND {U.is_external_link(href, 'base', f'{v}.domain')})"
        bait = f"(coalesce(bait, false) AND {U.is_bait_domain(f'{v}.domain')})"
        short = U.short_link(f"{v}.domain")
        tld = f"{v}.tld IS NOT NULL"
        risk = U.points((external, 2), (tld, U.tld_weight(f"{v}.tld")), (short, 3), (bait, 2))
        reasons = U.reasons((external, lit(V.REASON_EXTERNAL_LINK)),
                            (tld, f"concat({lit(V.REASON_TLD)}, {v}.tld)"),
                            (short, lit(V.REASON_SHORT)), (bait, lit(V.DOM_BAIT_REASON)))
        return only(
            when(f"size({v}.hiding) > 0", _row(
                "hidden_link", "6", "hidden_element", href, _OUTER[300],
                description=_filled("hidden_link", f"array_join({v}.hiding, ', ')"))),
            when(f"{risk} >= 4", _described(
                "suspicious_link", f"least(10, {risk})", "suspicious_url", href, _OUTER[300],
                reasons=reasons, link_text="left(trim(text), 100)")))

    domain = U.netloc(href)
    found = let(rows, domain=domain, tld=U.suspicious_tld(domain), hiding=hiding)
    return f"IF({U.is_web(href)} AND NOT {U.is_trusted_cdn(href)}, {found}, array())"


def _form():
    action = _attr("action")
    away = f"(coalesce(base, '') != '' AND {U.netloc(action)} != '' AND {U.netloc(action)} != base)"
    return only(
        when(U.is_web(action), _row(
            "external_form", f"IF({away}, 7, 4)", "suspicious_pattern", action, _OUTER[500],
            description=f"IF({away}, {lit(V.DOM_DESCRIPTIONS['form_external'])}, "
                        f"{lit(V.DOM_DESCRIPTIONS['form_absolute'])})")),
        when("startswith(location, 'http://') AND array_contains(field_types, 'password')", _described(
            "insecure_login", "6", "suspicious_pattern",
            f"concat('Password field on HTTP page, action=', coalesce(nullif({action}, ''), '(none)'))",
            _OUTER[400])))


def _input():
    name, value = f"lower({_attr('name')})", f"lower({_attr('value')})"
    hidden = f"form_no IS NOT NULL AND {_attr('type')} = 'hidden'"
    return only(
        when(f"{hidden} AND {contains_any(name, V.DOM_SENSITIVE_NAMES)}", _row(
            "sensitive_hidden_field", "3", "suspicious_pattern", _OUTER[200], name,
            description=_filled("sensitive_hidden_field", name))),
        when(f"{hidden} AND {contains_any(value, ['http', 'script'])}", _described(
            "suspicious_hidden_value", "5", "suspicious_pattern", _OUTER[200], value)))


def _any_element():
    style = f"replace(lower({_attr('style')}), ' ', '')"
    joined = f"array_join(filter(split({_attr('class')}, ' '), c -> c != ''), ' ')"

    def hidden(name, severity, condition):
        return when(condition, _row(name, severity, "hidden_element", _OUTER[200], _OUTER[300],
                                    description=_filled(name, "tag")))

    return only(
        hidden("styled_hidden", "3", contains_any(style, ["display:none", "visibility:hidden"])),
        hidden("zero_opacity", "4", f"contains({style}, 'opacity:0') AND NOT contains({style}, 'display:none')"),
        hidden("offscreen_positioned", "5", has_match(style, V.DOM_OFFSCREEN)),
        hidden("hidden_attribute", "2", "map_contains_key(attrs, 'hidden')"),
        when(contains_any(f"lower({joined})", V.DOM_HIDING_CLASSES), _row(
            "hiding_class", "3", "hidden_element", f"concat('class=\"', {joined}, '\"')", _OUTER[300],
            description=_filled("hiding_class", "tag", f"lower({joined})"))))


def dom_findings(pages: DataFrame) -> DataFrame:
    """All element rules over the rows of ``looked_at``; a whole scan has them in its one pass instead."""
    rows = looked_at(pages).where("tag != '#error'").selectExpr("*", f"{U.page_domain('location')} AS base")
    return to_findings(rows, element_findings())


def element_findings(errors: bool = False) -> str:
    """SQL array of the findings of an element: columns tag, attrs, text, bait, outer_html, form_no, field_types,
    location, and base, the page's domain.  A tree that failed gives an error, if asked for."""
    by_tag = f"""CASE tag WHEN 'script' THEN {_script()} WHEN 'iframe' THEN {_iframe()}
        WHEN 'a' THEN {_link()} WHEN 'form' THEN {_form()} WHEN 'input' THEN {_input()} ELSE array() END"""
    failed = f"array({finding(lit('#dom'), '0', lit('error'), lit(''), 'text')})" if errors else "array()"
    return f"IF(tag = '#error', {failed}, concat({by_tag}, {_any_element()}))"


_NAMES = ("elem_no", "tag", "attrs", "text", "bait", "outer_html", "form_no", "field_types")


def _elements_of(texts: pa.Array) -> list[list[dict]]:
    out = []
    for text in texts.to_pylist():
        try:
            out.append([dict(zip(_NAMES, row)) for row in _Page(text or "").looked_at()])
        except Exception as error:  # one broken page must not stop the scan
            out.append([dict.fromkeys(_NAMES) | {"tag": "#error", "text": str(error)}])
    return out


#: The elements of a page as one value.
ELEMENT = "struct<elem_no: int, tag: string, attrs: map<string, string>, text: string, bait: boolean, outer_html: string, " \
          "form_no: int, field_types: array<string>>"
FACT = Fact("elements", f"array<{ELEMENT}>", pa.list_(pa.struct([(n, _TYPES[n]) for n in _NAMES])), _elements_of)
