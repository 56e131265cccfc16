"""Page text to findings in one pass.

Every rule in use contributes its matches to one array per page; the array is exploded
once, and plain columns on the exploded rows turn matches into findings.  No shuffle and
no state, so the same functions serve batch and streaming tables.
"""

import re

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescan.functions import urls as U
from pagescan.functions.dialect import to_java, to_re2
from pagescan.functions.linear import Fact, Pattern, matcher
from pagescan.functions.text import (
    around, contains_any, each, first_word, fold, from_char, has_match, let, lit, lits, one_line, only,
    pieces, spans, struct, valid, when)
from pagescan.operators import catalog as C
from pagescan.operators import dom as D
from pagescan.operators.custom import custom_fact, is_custom
from pagescan.operators.keywords import blocks, keyword_fact
from pagescan.rules import values as V
from pagescan.schema import finding, text_map, to_findings

# What a match can carry besides its text: keywords have a name, a category and a weight.
_LABELS = {"label": "STRING", "note": "STRING", "level": "INT"}
_NO_ELEMENT = f"CAST(NULL AS {D.ELEMENT})"
_UNLABELLED = {**{name: f"CAST(NULL AS {kind})" for name, kind in _LABELS.items()}, "element": _NO_ELEMENT}
_KEPT = ("rule", *_LABELS, "element")


# --- matches ---------------------------------------------------------------------

_URL_GUARDS = {V.URL_HTTP: "http", V.URL_PATH: "/", V.URL_JAVASCRIPT: "javascript:", V.URL_DATA: ";base64,"}


def _guards(rules, keywords=()) -> list[str]:
    """The literals whose presence decides which patterns are tried."""
    words = {guard.lower() for rule in rules for guard in rule.guards}
    if any(rule.kind in ("url", "link") for rule in rules):
        words |= set(_URL_GUARDS.values())
    words |= set(_few(keywords))
    return sorted(word for word in words if len(word) > 1)


def _few(keywords) -> list[str]:
    """The ASCII keywords, where they are few: without one a page of ASCII text needs no look."""
    words = [k["folded"] for k in keywords if k["folded"].isascii()]
    return words if len(words) <= 16 else []


def _seen(guards, words) -> str:
    """One of the guards occurs on the page."""
    return "(" + " OR ".join(f"contains(folded, {lit(g.lower())})" if len(g) == 1 else f"sees_{words.index(g.lower())}"
                              for g in guards) + ")"


def _fixed(rule: C.Rule, number: int) -> dict:
    return dict(rule=lit(number), margin=lit(rule.margin), until=f"CAST({lit(rule.until)} AS INT)", **_UNLABELLED)


def _taken(place: int, **extra: str) -> str:
    """The matches of a linear pattern as an entry; NULL where it was not tried or found nothing."""
    column = f"linear.p{place}"
    return when(f"{column} IS NOT NULL", struct(**{n: f"{column}.{n}" for n in ("found", "gaps", "g1", "g2")}, **extra))


def _with_linear(pages: DataFrame, tries, facts=()) -> DataFrame:
    """Pages with the column ``linear``: what ``tries`` and ``facts``, pairs of a pattern or fact and its condition, find."""
    if not tries and not facts:
        return pages
    bits = " | ".join(f"IF({condition or 'true'}, {1 << k}L, 0L)" for k, (_, condition) in enumerate([*tries, *facts]))
    asked = pages.selectExpr("*", f"{bits} AS bits")
    return asked.withColumn("linear", matcher([p for p, _ in tries], tuple(f for f, _ in facts))(
        F.expr("IF(bits = 0, NULL, content)"), F.col("bits"))).drop("bits")


def _linear_try(rule: C.Rule, words) -> tuple:
    conditions = [_seen(rule.guards, words)] if rule.guards else []
    if rule.requires:
        conditions.append(has_match("content", rule.requires, rule.flags))
    return Pattern(rule.pattern, rule.flags, rule.groups, rule.before, rule.at_least), " AND ".join(conditions)


def _data_try(words) -> tuple:
    return Pattern(V.URL_DATA, "i"), _seen([_URL_GUARDS[V.URL_DATA]], words)


def _entry(rule: C.Rule, number: int, words) -> str:
    fixed = _fixed(rule, number)
    rx = lit(rule.regex())
    if rule.upto or rule.tail:
        head = (f"left(content, length(content) - length(substring_index(content, {lit(rule.upto)}, -1)))" if rule.upto
                else f"regexp_extract(content, {lit('(?s)^.*' + to_java(f'(?:{rule.tail})', rule.flags))}, 0)")
        entry = let(lambda v: pieces(f"{v}.head", rx, rule.groups, rule.at_least,
                                     rest=from_char("content", f"length({v}.head) + 1"), **fixed), head=head)
    else:
        entry = pieces("content", rx, rule.groups, rule.at_least, **fixed)
    conditions = [_seen(rule.guards, words)] if rule.guards else []
    if rule.requires:
        conditions.append(has_match("content", rule.requires, rule.flags))
    return when(" AND ".join(conditions) or None, entry)


def _keyword_try(spark, keywords, words) -> tuple:
    few = _few(keywords)
    if not few and any(k["folded"].isascii() for k in keywords):
        return keyword_fact(spark, keywords), "true"
    wide = "octet_length(content) > char_length(content)"
    return keyword_fact(spark, keywords), f"({wide} OR {_seen(few, words)})" if few else wide


def _url_spans(patterns, words, data_place: int) -> str:
    """First occurrence of each URL of a page: ``array<struct<text, number, start, stop, context>>``.

    Sorting by URL finds the first occurrences without a shuffle or a quadratic search.
    """
    entries = only(*[_taken(data_place, number=lit(i)) if rx == V.URL_DATA else
                     when(_seen([_URL_GUARDS[rx]], words), pieces("content", lit(to_java(rx, "i")), number=lit(i)))
                     for i, rx in enumerate(patterns)])
    found = "flatten(" + each("transform", entries, lambda e: each(
        "transform", spans(e, "50", keep=("number",)), lambda s: struct(
            text=f"{s}.text", number=f"{s}.number", start=f"{s}.start", stop=f"{s}.stop",
            context=around(s)))) + ")"
    long_enough = each("filter", found, lambda u: f"length({u}.text) >= 3")
    return let(lambda v: each("filter", f"{v}.urls", lambda u, i: (
        f"{i} = 0 OR {u}.text != get({v}.urls, {i} - 1).text"), indexed=True),
        urls=f"sort_array({long_enough})")


def _inside_paths(web: pa.Array, paths: pa.Array) -> pa.Array:
    """For each page a flag for each path: is it part of one of the web addresses?

    The paths of a page are one automaton, and its addresses run through that once, so many of both are
    no work for each pair.
    """
    out = []
    for addresses, own in zip(web.to_pylist(), paths.to_pylist()):
        found = set()
        if addresses and own:
            tree = ahocorasick.Automaton()
            for path in own:
                tree.add_word(path, path)
            tree.make_automaton()
            # No path holds a line end.
            found = {path for _, path in tree.iter("\n".join(addresses))}
        out.append([path in found for path in own or ()])
    return pa.array(out, pa.list_(pa.bool_()))


def extract_urls(pages: DataFrame) -> DataFrame:
    """Every URL a page mentions, once: page_id, location, url, context, offsets.

    Rooted paths that are part of a web address of the page are left out.
    """
    words = _guards([C.URL])
    found = _url_spans([V.URL_HTTP, V.URL_PATH, V.URL_JAVASCRIPT, V.URL_DATA], words, 0)
    is_path = lambda u: f"startswith({u}.text, '/')"
    kept = let(lambda v: f"concat({v}.rest, {each('filter', f'{v}.paths', lambda _, i: f'NOT inside[{i}]', indexed=True)})",
               rest=each("filter", "urls", lambda u: f"NOT {is_path(u)}"), paths=each("filter", "urls", is_path))
    texts = lambda condition: F.expr(each("transform", each("filter", "urls", condition), lambda u: f"{u}.text"))
    inside = F.arrow_udf(_inside_paths, "array<boolean>").asNondeterministic()
    return (_with_linear(_folded(pages, words), [_data_try(words)]).selectExpr("page_id", "location", f"{found} AS urls")
            .withColumn("inside", inside(texts(lambda u: f"startswith({u}.text, 'http')"), texts(is_path)))
            .selectExpr("page_id", "location", f"inline({kept})")
            .selectExpr("page_id", "location", "text AS url", "context", "start AS pos_start",
                        "stop AS pos_end", "number AS pattern_no"))


def _folded(pages: DataFrame, words) -> DataFrame:
    """Pages with their folded text and a column per guard word: does it occur?

    The searches are a projection of their own, so they run as generated code and once per
    word, not interpreted within the large expression that uses them.
    """
    folded = pages.selectExpr("page_id", "location", valid("content")).selectExpr("*", f"{fold('content')} AS folded")
    return folded.selectExpr("*", *[f"contains(folded, {lit(w)}) AS sees_{i}" for i, w in enumerate(words)])


_NOT_PATTERNS = ("keyword", "url", "link", "element", "entropy", "color", "custom", "error")


def _hits(pages: DataFrame, rules, keywords) -> DataFrame:
    """Exploded matches: page_id, location and one struct ``hit`` per match."""
    numbers, words = {r.kind: i for i, r in enumerate(rules) if r.kind in _NOT_PATTERNS}, _guards(rules, keywords)
    address = numbers.get("url", numbers.get("link"))
    slow = [i for i, r in enumerate(rules) if r.linear]
    tries = [_linear_try(rules[i], words) for i in slow] + ([_data_try(words)] if address is not None else [])
    plain = [_taken(slow.index(i), **_fixed(r, i)) if r.linear else _entry(r, i, words)
             for i, r in enumerate(rules) if r.kind not in _NOT_PATTERNS]
    facts, arrays = [], []

    def bare(number, **values):
        return struct(**{"text": "''", "start": "0", "stop": "0", "before": "''", "after": "''", "g1": "CAST(NULL AS STRING)",
                         "g2": "CAST(NULL AS STRING)", "n": "1", "rule": lit(number), **_UNLABELLED, **values})

    def taken(name, number, *fields, **values):
        """The matches that a fact holds, with those of its fields."""
        return "coalesce(" + each("transform", f"linear.{name}", lambda e: bare(
            number, **{f: f"{e}.{f}" for f in fields}, **{k: v(e) for k, v in values.items()})) + ", array())"

    if plain:
        every = f"array_compact({only(*plain)})"
        arrays.append("flatten(" + each("transform", every, lambda e: spans(
            e, f"{e}.margin", f"{e}.until", keep=_KEPT)) + ")")
    if "keyword" in numbers and keywords:
        facts.append(_keyword_try(pages.sparkSession, keywords, words))
        arrays.append(taken("keywords", numbers["keyword"], "text", "start", "stop", "before", "after", *_LABELS))
    if address is not None:
        # Rooted paths never score, so findings need the other three shapes only.
        arrays.append(each("transform", _url_spans([V.URL_HTTP, V.URL_JAVASCRIPT, V.URL_DATA], words, len(slow)), lambda u: bare(
            address, text=f"{u}.text", start=f"{u}.start", stop=f"{u}.stop", before=f"{u}.context")))
    if "element" in numbers:
        facts.append((D.FACT, f"content != '' AND {D.can_fire('folded')}"))
        arrays.append(taken("elements", numbers["element"], "text", element=lambda e: e))
    if "entropy" in numbers:
        facts.append((ENTROPY_FACT, "true"))
        arrays.append(f"IF(linear.entropy.bits > 3.8, array({bare(
            numbers['entropy'], before="IF(linear.entropy.bits > 4.5, 'high', 'medium')", g1='linear.entropy.shown', g2='linear.entropy.rounded')}), array())")
    if "color" in numbers:
        facts.append((COLOR_FACT, _seen(rules[numbers["color"]].guards, words)))
        arrays.append(taken("colors", numbers["color"], "text", "start", "stop", "before", "after", "g1"))
    own = [i for i, r in enumerate(rules) if is_custom(r)]
    if own:
        # They stand together, and a match says which it is of.
        facts.append((custom_fact([rules[i] for i in own], own[0]), "true"))
        arrays.append(each("filter", taken("custom", 0, "text", "start", "stop", "before", "after", rule=lambda e: f"{e}.rule", g1=lambda e: f"{e}.error"),
                           lambda h: f"{h}.g1 IS NULL"))
    if "error" in numbers and (tries or facts):
        arrays.append(taken("failed", numbers["error"], text=lambda e: e, g1=lambda e: "'page'"))
        if own:
            failed = each("filter", "linear.custom", lambda e: f"{e}.error IS NOT NULL")
            arrays.append(f"coalesce({each('transform', failed, lambda e: bare(numbers['error'], text=f'{e}.error', g1=lit('rule')))}, array())")
    return _with_linear(_folded(pages, words), tries, facts).selectExpr(
        "page_id", "location", f"inline(concat({', '.join(arrays) or 'array()'}))")


# --- matches to findings -----------------------------------------------------------

_CONTEXT = one_line("concat(before, text, after)")


def _row(evidence="coalesce(r.evidence, text)", severity="r.severity", context=_CONTEXT, rule_id="r.key",
         reasons="array()", **metadata) -> str:
    """A finding with the attributes of its rule ``r``, where not given otherwise."""
    extra = f"map_concat(r.metadata, {text_map(metadata)})" if metadata else "r.metadata"
    return finding(rule_id, severity, "r.category", "r.source_type", f"left({evidence}, r.cut)", context,
                   "IF(r.placed, start, 0)", "IF(r.placed, stop, 0)", reasons, extra)


def _comment(rule_id, severity, category, evidence, context, reasons="array()", **metadata) -> str:
    return finding(lit(rule_id), lit(severity), lit(category), "'comments'", evidence, context,
                   reasons=reasons, metadata=metadata)


def _plain():
    return f"array({_row()})"


def _js_call():
    """Calls that change the document count under a second rule as well."""
    name = "r.metadata['function']"
    return only(_row(), when(f"{name} IN ({lits(V.JS_DOM_OPERATIONS)})", finding(
        f"concat('js:dom:', {name})", "r.severity", "r.category", "r.source_type", "text", _CONTEXT, "start", "stop",
        metadata={"operation": name})))


def _count(evidence: str, number: str = "n") -> str:
    return f"replace({evidence}, '%d', CAST({number} AS STRING))"


def _js_count():
    # Where a rule has a lead, group 1 is text before the match proper.
    text = from_char("text", "length(coalesce(g1, '')) + 1")
    before = "right(concat(before, coalesce(g1, '')), 80)"
    return f"array({_row(evidence=_count(lit(V.EVIDENCE_MATCHES)), severity='IF(n >= 10, 4, 3)',
                         context=one_line(f'concat({before}, {text}, after)'), count='n')})"


def _css_count():
    severity = "IF(r.key = 'css:obfuscation:long_names' AND n >= 10, 4, 3)"
    return f"array({_row(evidence=_count('r.evidence'), severity=severity, context="''", count='n')})"


def _css_value():
    """``opacity: 0.00`` holds the listed values 0, 0.0 and 0.00: one finding for each."""
    listed = "element_at(map(" + ", ".join(
        f"{lit(prop)}, array({lits(values)})" for prop, values in V.CSS_HIDING_VALUES.items()
        ) + "), r.metadata['property'])"
    held = each("filter", listed, lambda v: f"startswith({fold('g1')}, lower({v}))")

    def one(value):
        evidence = f"left(text, length(text) - length(g1) + length({value}))"
        tail = f"left(concat({from_char('g1', f'length({value}) + 1')}, after), 50)"
        return finding("r.key", "r.severity", "r.category", "r.source_type", evidence,
                       one_line(f"concat(before, {evidence}, {tail})"), "start", f"start + length({evidence})",
                       metadata={"property": "r.metadata['property']", "value": value})

    return each("transform", held, one)


def _css_absolute():
    digits = f"ltrim('0', regexp_extract(text, {lit(to_java(V.CSS_ABSOLUTE_DIGITS, 'i'))}, 1))"
    return "array(" + finding(
        "r.key", f"IF(length({digits}) > 4, 4, 3)", "r.category", "r.source_type", "text",
        _CONTEXT, "start", "stop") + ")"


def _css_import():
    url = "coalesce(nullif(g1, ''), g2)"
    return only(when(U.is_external_link(url), _row(evidence=url, reasons=f"array({lit(V.REASON_CSS_IMPORT)})")))


def _zero_width():
    return f"array({_row(evidence=_count(lit(V.EVIDENCE_ZERO_WIDTH)), count='n')})"


def _entities():
    return f"array({_row(evidence=_count(lit(V.EVIDENCE_ENTITIES)), count='n')})"


def _whitespace():
    bare = "NOT contains(concat(before, after), '<') AND NOT contains(concat(before, after), '>')"
    return only(when(bare, _row(evidence=_count(lit(V.EVIDENCE_WHITESPACE), "length(text)"), count="length(text)")))


def _color():
    ink, window = "lower(g1)", "concat(before, text, after)"
    paper = f"regexp_extract({window}, {lit(to_java(V.BACKGROUND_COLOR, 'i'))}, 1)"
    alike = (f"({ink} = lower({paper}) OR ({ink} IN ({lits(V.BLACKS)}) AND lower({paper}) IN ({lits(V.BLACKS)})) "
             f"OR ({ink} IN ({lits(V.WHITES)}) AND lower({paper}) IN ({lits(V.WHITES)})))")
    first, second = V.EVIDENCE_COLOR
    return only(when(f"{paper} != '' AND {alike}", _row(
        evidence=f"concat({lit(first)}, {ink}, {lit(second)}, {paper})",
        context=one_line("concat(right(before, 50), text, left(after, 50))"), text_color=ink, bg_color=paper)))


def _number(text: str) -> str:
    return f"abs(try_cast(regexp_extract({text}, '[0-9]+(\\\\.[0-9]+)?', 0) AS DOUBLE))"


def _position():
    return only(when(f"{_number('g2')} > 1000", _row(evidence="concat(g1, ':', g2)", direction="g1", value="g2")))


def _indent():
    return only(when(f"{_number('g1')} > 50", _row(evidence="g1", indent="g1")))


def _font():
    return f"array({_row(size='g1')})"


def _meta():
    return f"array({_row(evidence=f'rtrim({lit(chr(34) + chr(39))}, g2)', context='text',
                         reasons=f'array({lit(V.REASON_META)})')})"


def _html_comment():
    head = "left(g1, 200)"
    rows = " ".join(
        f"WHEN {has_match('g1', pattern, flags)} THEN "
        + _comment(f"html:comment:{name}", severity, "suspicious_pattern", head, head, description=lit(description))
        for name, pattern, flags, severity, description in V.HTML_COMMENT_RULES)
    links = each("transform", f"regexp_extract_all(g1, {lit(to_java(V.HTML_COMMENT_LINK))}, 1)", lambda url: _comment(
        "html:comment:link", 3, "suspicious_url", url, head, reasons=f"array({lit(V.REASON_COMMENT_LINK)})"))
    return f"concat({only(f'CASE {rows} END')}, {links})"


def _comment_word(rule_id, category, words):
    word = first_word("lower(g1)", words)
    return when(contains_any("lower(g1)", words), _comment(
        rule_id, 3, category, word, "left(g1, 200)", keyword=word))


def _line_comment():
    return only(_comment_word("js:comment:suspicious", "js_issue", V.JS_COMMENT_WORDS))


def _block_comment():
    encoded = f"length(g1) > 50 AND {has_match('g1', V.BASE64_RUN)}"
    return only(_comment_word("js:comment:suspicious", "js_issue", V.JS_COMMENT_WORDS),
                when(encoded, _comment("js:comment:base64", 4, "js_issue", lit(V.EVIDENCE_BASE64), "left(g1, 200)")),
                _comment_word("css:comment:suspicious", "css_issue", V.CSS_COMMENT_WORDS))


def _keyword():
    return f"array({_row(evidence='label', severity='level', rule_id="concat('keyword:', label)",
                         context=f'left({_CONTEXT}, 200)', keyword='label', category='note', weight='level')})"


def _entropy():
    return "array(" + _entropy_finding("before = 'high'", "g1", "g2") + ")"


def _entropy_finding(high: str, shown: str, rounded: str) -> str:
    return finding(f"IF({high}, 'js:entropy:high', 'js:entropy:medium')", f"IF({high}, 4, 2)", "'js_issue'", "'js'",
                   f"replace({lit(V.EVIDENCE_ENTROPY)}, '%.2f', {shown})", metadata={"entropy": rounded})


def _link():
    """The view of one URL as a link of the page; ``u`` holds its facts."""
    return only(_as_link())


def _address(rule_id, severity, source_type, why, evidence="text"):
    return finding(lit(rule_id), severity, "'suspicious_url'", lit(source_type), evidence, "before",
                   "start", "stop", why)


def _as_link():
    return let(lambda v: when(f"{v}.it.risk > 0", _address(
        "html:suspicious_url", f"least({v}.it.risk, 10)", "html", f"{v}.it.reasons")), it=U.link_risk("text", "u"))


def _bad_address():
    return when(f"lower(left(text, 4)) = 'http' AND {U.has_bad_port('text')}", _failed("'url'", "text"))


def _failed(stage: str, message: str) -> str:
    return finding(f"concat('#', {stage})", "0", "'error'", "''", message)


def _error():
    return f"array({_failed('g1', 'text')})"


def _url():
    """The HTML, style and script views of one URL; ``u`` holds its facts."""
    row, html = _address, _as_link()
    css = f"""CASE
        WHEN startswith(text, 'javascript:') THEN {row(
            'css:url:javascript', '5', 'css', f'array({lit(V.REASON_CSS_JS)})')}
        WHEN startswith(text, 'data:') THEN {row(
            'css:url:data', 'IF(length(text) > 500, 5, 4)', 'css', f'array({lit(V.REASON_DATA)})', 'left(text, 200)')}
        WHEN {U.is_external_link('text', domain='u.domain')} AND NOT u.cdn THEN {row(
            'css:url:external', '2', 'css', f'array({lit(V.REASON_CSS_EXTERNAL)})')} END"""
    random_name = has_match("text", V.RANDOM_JS_NAME)
    js = when(U.is_external_link("text", "u.base", "u.domain"), row(
        "js:dynamic_url", f"least(5, 3 + {U.tld_weight('u.tld')} + IF({random_name}, 1, 0))", "js",
        U.reasons(("true", lit(V.REASON_JS_EXTERNAL)),
                  ("u.tld IS NOT NULL", f"concat({lit(V.REASON_JS_TLD)}, u.tld)"),
                  (random_name, lit(V.REASON_JS_RANDOM)))))
    return only(html, css, js)


_KINDS = {"plain": _plain, "js_call": _js_call, "js_count": _js_count, "css_count": _css_count,
          "css_value": _css_value, "css_absolute": _css_absolute, "css_import": _css_import,
          "zero_width": _zero_width, "entities": _entities, "whitespace": _whitespace, "color": _color,
          "position": _position, "indent": _indent, "font": _font, "meta": _meta,
          "html_comment": _html_comment, "line_comment": _line_comment, "block_comment": _block_comment,
          "keyword": _keyword, "url": _url, "link": _link, "element": D.element_findings, "entropy": _entropy, "custom": _plain,
          "error": _error}
_UNCUT = 2**31 - 1


def text_findings(pages: DataFrame, rules, keywords=(), errors: bool = False) -> DataFrame:
    """Findings of the given catalog and user rules over ``pages(page_id, location, content)``.

    Keyword lists beyond ``keywords.MOST_CHARS`` take a further pass for each such block.  With ``errors`` there is also a row for
    whatever could not be judged: its rule_id is ``#`` and the stage that failed, its evidence the message; what fails on a page
    costs that page the failing part only.
    """
    first, *more = blocks(list(keywords))
    found = _text_findings(pages, list(rules), first, errors)
    for block in more:
        found = found.unionByName(_text_findings(pages, [r for r in rules if r.kind == "keyword"], block, False))
    return found


def _texts(values) -> str:
    return f"CAST(array({lits(values)}) AS ARRAY<STRING>)"


def _text_findings(pages: DataFrame, rules: list, keywords: list, errors: bool) -> DataFrame:
    # User rules stand together at the end.
    rules = [r for r in rules if not is_custom(r)] + ([C.ERROR] if errors else []) + [r for r in rules if is_custom(r)]
    table = "array(" + ", ".join(struct(
        key=lit(r.key), severity=lit(r.severity), category=lit(r.category), source_type=lit(r.source_type),
        cut=lit(r.cut or _UNCUT), evidence=f"CAST({lit(r.evidence)} AS STRING)", placed=lit(r.placed),
        names=_texts(r.metadata), values=_texts(r.metadata.values())) for r in rules) + ")"
    kinds = dict.fromkeys(r.kind for r in rules)
    address = next((i for i, r in enumerate(rules) if r.kind in ("url", "link")), None)

    def arm(kind):
        if kind == "element":
            return D.element_findings(errors)
        if kind in ("url", "link") and errors:
            return f"concat({_KINDS[kind]()}, {only(_bad_address())})"
        return _KINDS[kind]()

    by_kind = "CASE " + " ".join(
        f"WHEN rule IN ({lits(i for i, r in enumerate(rules) if r.kind == kind)}) THEN {arm(kind)}"
        for kind in kinds) + " END"
    # Maps as literals equal nothing, not even themselves, and Spark would not see that two uses of the findings are the same.
    hits = _hits(pages, rules, keywords).selectExpr("*", f"get({table}, rule) AS listed").selectExpr("*", struct(
        **{n: f"listed.{n}" for n in ("key", "severity", "category", "source_type", "cut", "evidence", "placed")},
        metadata="map_from_arrays(listed.names, listed.values)") + " AS r")
    if address is not None:
        hits = hits.selectExpr("*", f"{when(f'rule = {address}', U.url_facts('text', 'location'))} AS u")
    if "element" in kinds:
        hits = hits.selectExpr("*", *[f"element.{n} AS {n}" for n in ("tag", "attrs", "bait", "outer_html", "form_no", "field_types")],
                               f"{U.page_domain('location')} AS base")
    return to_findings(hits, by_kind)


# --- colours -------------------------------------------------------------------------------

# Where a text colour begins: all of it, or up to an opening bracket.
_COLOR_HEAD = re.compile(V.TEXT_COLOR_HEAD, re.I)
_COLOR_MARGIN = 200
_COLOR_FIELDS = [("text", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("before", pa.string()), ("after", pa.string()),
                 ("g1", pa.string())]


def _colors(texts: pa.Array) -> list[list[dict]]:
    """The text colours of each page with what stands around them.

    A bracket's end is looked for only while there is one ahead, and nothing inside a match is looked at again, so a
    page that opens brackets and never closes them costs no more than its length.
    """
    out = []
    for text in texts.to_pylist():
        rows, free, last = [], 0, (text or "").rfind(")")
        for head in _COLOR_HEAD.finditer(text or ""):
            start, stop = head.span()
            if start < free:
                continue
            if head[1] is None:
                # At least one character and then the bracket.
                if stop >= last or text[stop] == ")":
                    continue
                stop = text.index(")", stop) + 1
            free = stop
            begin = head.start(1) if head[1] is not None else head.start(2)
            rows.append({"text": text[start:stop], "start": start, "stop": stop, "before": text[max(0, start - _COLOR_MARGIN):start],
                         "after": text[stop:stop + _COLOR_MARGIN], "g1": text[begin:stop]})
        out.append(rows)
    return out


COLOR_FACT = Fact("colors", "array<struct<text: string, start: int, stop: int, before: string, after: string, g1: string>>",
                  pa.list_(pa.struct(_COLOR_FIELDS)), _colors)


# --- entropy -------------------------------------------------------------------------

def _without_comments(texts: pa.Array) -> pa.Array:
    """Code without line and block comments.

    No block comment ends after the last end mark, so what follows the line of that mark is rid of
    line comments only; an unclosed block is then no work for every comment behind it.
    """
    heads, tails = [], []
    for text in texts.to_pylist():
        last = (text or "").rfind("*/")
        line = text.find("\n", last) if last >= 0 else 0
        cut = len(text or "") if line < 0 else line
        heads.append((text or "")[:cut])
        tails.append((text or "")[cut:])
    both = [pc.replace_substring_regex(pa.array(part, pa.string()), pattern=pattern, replacement="")
            for part, pattern in ((heads, to_re2(V.CODE_COMMENTS, "s")), (tails, r"//[^\n]*"))]
    return pc.binary_join_element_wise(*both, "")


def _entropies(texts: pa.Array) -> list[dict]:
    """Shannon entropy of the characters of each text without comments, in bits, 0 for an empty one; and
    with two places, rounded half to even from the exact value."""
    def entropy(text):
        if not text:
            return 0.0
        counts = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), return_counts=True)[1]
        share = counts / counts.sum()
        return float(-(share * np.log2(share)).sum())

    bits = [entropy(text) for text in _without_comments(texts).to_pylist()]
    return [{"bits": e, "shown": f"{e:.2f}", "rounded": str(round(e, 2))} for e in bits]


ENTROPY_FACT = Fact("entropy", "struct<bits: double, shown: string, rounded: string>", pa.struct(
    [("bits", pa.float64()), ("shown", pa.string()), ("rounded", pa.string())]), _entropies)


def entropy_findings(pages: DataFrame) -> DataFrame:
    """One finding per page whose text without comments looks encoded."""
    return text_findings(pages, [C.ENTROPY])
