"""SQL for another engine that says what each rule must find on the check corpus.

Patterns here are the rules' own, without the rewrites the Spark side uses to stay linear
on the JVM; look-arounds, which RE2 lacks, are expressed by what they leave out.
"""

from oracle.corpus import corpus_sql, plain
from pagescan.functions.dialect import to_re2
from pagescan.rules import values as V
from pagescan.rules.loaders import built_in_keywords

COLUMNS = ("page_id, location, rule_id, severity, category, source_type, evidence, context, "
           "pos_start, pos_end, reasons")


def rx(pattern: str, flags: str = "") -> str:
    return plain(to_re2(pattern, flags))


def items(values) -> str:
    return ", ".join(plain(v) if isinstance(v, str) else str(v) for v in values)


def flat(text: str) -> str:
    return f"replace(replace({text}, chr(10), ' '), chr(13), ' ')"


def window(margin: int, start="start", stop="stop") -> str:
    return (f"substring(content, greatest({start} - {margin}, 0) + 1, "
            f"{stop} + {margin} - greatest({start} - {margin}, 0))")


def ctx(margin: int, start="start", stop="stop") -> str:
    return flat(window(margin, start, stop))


def spans(pattern: str, flags: str = "", groups=(), source: str = "corpus") -> str:
    """All matches: page_id, location, content, i, n, text, start, stop, g1, ..."""
    p = rx(pattern, flags)
    found = "".join(f", regexp_extract_all(content, {p}, {g}) AS a{g}" for g in groups)
    picked = "".join(f", a{g}[i] AS g{g}" for g in groups)

    def size(part):
        return f"coalesce(list_sum(list_transform({part}, lambda y: length(y))), 0)"

    return f"""(SELECT *, start + length(text) AS stop FROM (
        SELECT page_id, location, content, i, len(m) AS n, m[i] AS text{picked},
               CAST({size('g[1:i]')} + {size('m[1:i-1]')} AS INT) AS start
        FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i
              FROM (SELECT *, regexp_extract_all(content, {p}) AS m,
                           string_split_regex(content, {p}) AS g{found} FROM {source}))))"""


def row(rule_id, severity, category, source_type, evidence, context="''", placed=True, reasons="''",
        source="", where="true") -> str:
    def text(v):
        return v if v.startswith("(") else plain(v)

    start, stop = ("start", "stop") if placed else ("0", "0")
    return (f"SELECT page_id, location, {text(rule_id)} AS rule_id, {severity} AS severity, {plain(category)} AS category, "
            f"{plain(source_type)} AS source_type, {evidence} AS evidence, {context} AS context, "
            f"{start} AS pos_start, {stop} AS pos_end, {reasons} AS reasons FROM {source} WHERE {where}")


def union(*arms) -> str:
    return "\nUNION ALL\n".join(arms)


def with_corpus(body: str) -> str:
    return f"WITH corpus AS ({corpus_sql()})\n{body}"


def only(body: str, condition: str) -> str:
    return f"SELECT {COLUMNS} FROM ({body}) WHERE {condition}"


# --- text rules ------------------------------------------------------------------------

def first_word(text: str, words) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, {plain(w)}) THEN {plain(w)}" for w in words) + " END"


def html_texts() -> dict:
    arms = {f"html:pattern:{name}": row(
        f"html:pattern:{name}", severity, "suspicious_pattern", "html", "text", ctx(50), source=spans(pattern, "i"))
        for name, pattern, severity, _, _ in V.HTML_PATTERNS}
    arms["html:hidden_element"] = row("html:hidden_element", 2, "hidden_element", "html", "text", ctx(50),
                                      source=spans(V.HTML_HIDDEN, "i"))
    comments = spans(V.HTML_COMMENT, "s", (1,))
    names = "CASE " + " ".join(
        f"WHEN regexp_matches(g1, {rx(p, f)}) THEN 'html:comment:{n}'" for n, p, f, _, _ in V.HTML_COMMENT_RULES) + " END"
    arms["html:comment:rules"] = row(
        f"({names})", f"CASE WHEN {names} LIKE '%conditional%' THEN 1 ELSE 3 END", "suspicious_pattern", "comments",
        "left(g1, 200)", "left(g1, 200)", False, source=comments, where=f"{names} IS NOT NULL")
    arms["html:comment:link"] = row(
        "html:comment:link", 3, "suspicious_url", "comments", "link", "left(g1, 200)", False,
        plain(V.REASON_COMMENT_LINK),
        f"(SELECT *, unnest(regexp_extract_all(g1, {rx(V.HTML_COMMENT_LINK)}, 1)) AS link FROM {comments})")
    arms["html:meta:refresh"] = row(
        "html:meta:refresh", 3, "suspicious_url", "meta", "rtrim(g2, '\"''')", "text", False,
        plain(V.REASON_META), spans(V.HTML_META, "i", (2,)))
    return arms


def js_texts() -> dict:
    arms = {}
    for prefix, table in (("high_risk", V.JS_HIGH_RISK), ("dom", V.JS_DOM_OPERATIONS)):
        for name, severity in table.items():
            arms[f"js:{prefix}:{name}"] = row(f"js:{prefix}:{name}", severity, "js_issue", "js", "text", ctx(80),
                                              source=spans(rf"\b{name}\s*\("))
    for name, pattern, _, _ in V.JS_OBFUSCATION:
        pattern = r"\[.*\]\.join\s*\(\s*[\"']" if name == "array_join" else pattern
        arms[f"js:obfuscation:{name}"] = row(
            f"js:obfuscation:{name}", "CASE WHEN n >= 10 THEN 4 ELSE 3 END", "js_issue", "js",
            "n || ' 处匹配'", ctx(80), False, source=spans(pattern), where="i = 1 AND n >= 5")
    for name, pattern, severity, _, _ in V.JS_PATTERNS:
        arms[f"js:pattern:{name}"] = row(f"js:pattern:{name}", severity, "js_issue", "js", "left(text, 200)", ctx(80),
                                         source=spans(pattern))
    lines, blocks = spans(V.LINE_COMMENT, "", (1,)), spans(V.BLOCK_COMMENT, "s", (1,))
    for name, source in (("line", lines), ("block", blocks)):
        word = first_word("lower(g1)", V.JS_COMMENT_WORDS)
        arms[f"js:comment:{name}"] = row("js:comment:suspicious", 3, "js_issue", "comments", word, "left(g1, 200)", False,
                                         source=source, where=f"{word} IS NOT NULL")
    arms["js:comment:base64"] = row(
        "js:comment:base64", 4, "js_issue", "comments", plain(V.EVIDENCE_BASE64), "left(g1, 200)", False, source=blocks,
        where=f"regexp_matches(g1, {rx(V.BASE64_RUN)}) AND length(g1) > 50")
    arms["js:entropy"] = row(
        "(CASE WHEN e > 4.5 THEN 'js:entropy:high' ELSE 'js:entropy:medium' END)", "CASE WHEN e > 4.5 THEN 4 ELSE 2 END",
        "js_issue", "js", "printf('熵值 %.2f', e)", placed=False, where="e > 3.8", source=f"""(
            SELECT page_id, location, -sum(p * log2(p)) AS e FROM (
                SELECT page_id, location, count(*) / sum(count(*)) OVER (PARTITION BY page_id) AS p
                FROM (SELECT page_id, location, unnest(string_split(
                        regexp_replace(content, {rx(V.CODE_COMMENTS, 's')}, '', 'g'), '')) AS c FROM corpus)
                GROUP BY page_id, location, c) GROUP BY page_id, location)""")
    return arms


def css_texts() -> dict:
    def escaped(value):
        return "".join("\\" + c if c in "()." else c for c in value)

    arms = {f"css:hiding:{prop}": union(*[row(
        f"css:hiding:{prop}", 3, "hidden_element", "css", "text", ctx(50),
        source=spans(rf"{prop}\s*:\s*{escaped(value)}", "i")) for value in values])
        for prop, values in V.CSS_HIDING_VALUES.items()}
    arms["css:hiding:absolute_pos"] = row(
        "css:hiding:absolute_pos", "CASE WHEN CAST(g1 AS BIGINT) > 9999 THEN 4 ELSE 3 END", "hidden_element", "css",
        "text", ctx(50), source=spans(
            r"\.?[#\w][^{]+\{[^}]*(?:left|top|right|bottom)\s*:\s*-(\d{3,})(?:px|em|%)", "is", (1,)))
    for name, pattern, severity, _, _ in V.CSS_SELECTORS:
        arms[f"css:selector:{name}"] = row(f"css:selector:{name}", severity, "css_issue", "css", "text", ctx(50),
                                           source=spans(pattern))
    for name, pattern, _, _ in V.CSS_PROPERTIES:
        arms[f"css:property:{name}"] = row(f"css:property:{name}", 3, "css_issue", "css", "text", ctx(50),
                                           source=spans(pattern, "i"))
    url = "coalesce(nullif(g1, ''), g2)"
    arms["css:import:external"] = row(
        "css:import:external", 3, "css_issue", "css", url, ctx(40), reasons=plain(V.REASON_CSS_IMPORT),
        source=spans(V.CSS_IMPORT, "i", (1, 2)), where=rf"regexp_matches({url}, '^https?://[^/?#]')")
    counts = {"import:excessive": ("@import", "lower(content)", 11, "个 @import", "3"),
              "obfuscation:long_names": (V.CSS_LONG_NAMES, "content", 5, "个超长选择器", "CASE WHEN n >= 10 THEN 4 ELSE 3 END"),
              "obfuscation:control_chars": (V.CSS_CONTROL, "content", 11, "个控制字符", "3")}
    for name, (pattern, text, least, words, severity) in counts.items():
        arms[f"css:{name}"] = row(
            f"css:{name}", severity, "css_issue", "css", f"n || ' {words}'", placed=False, where=f"n >= {least}",
            source=f"(SELECT page_id, location, len(regexp_extract_all({text}, {rx(pattern)})) AS n FROM corpus)")
    word = first_word("lower(g1)", V.CSS_COMMENT_WORDS)
    arms["css:comment:suspicious"] = row(
        "css:comment:suspicious", 3, "css_issue", "comments", word, "left(g1, 200)", False,
        source=spans(V.BLOCK_COMMENT, "s", (1,)), where=f"{word} IS NOT NULL")
    return arms


def hiding_texts() -> dict:
    def hiding(name, evidence, context, source, where="true", severity=7, source_type="css"):
        return row(f"hiding:{name}", severity, "hidden_element", source_type, evidence, context, False,
                   source=source, where=where)

    def stretch(source, last):
        return f"""(SELECT page_id, location, content, n, min(start) AS start, max(stop) FILTER (i <= {last}) AS stop
                    FROM {source} GROUP BY page_id, location, content, n)"""

    number = "abs(CAST(regexp_extract({}, '-?[0-9]+(?:\\.[0-9]+)?') AS DOUBLE))"
    paper = f"regexp_extract({window(200)}, {rx(V.BACKGROUND_COLOR, 'i')}, 1)"
    alike = (f"(lower(g1) = lower({paper}) OR (lower(g1) IN ({items(V.BLACKS)}) AND lower({paper}) IN ({items(V.BLACKS)}))"
             f" OR (lower(g1) IN ({items(V.WHITES)}) AND lower({paper}) IN ({items(V.WHITES)})))")
    return {
        "hiding:zero_width": hiding("zero_width", "n || ' 个零宽字符'", ctx(50), stretch(spans(V.ZERO_WIDTH), "n"),
                                    source_type="text"),
        "hiding:whitespace": hiding(
            "whitespace", "'空白堆积 (' || length(text) || ' 个)'", ctx(50), spans(V.WHITESPACE_RUN),
            f"NOT contains({window(50)}, '<') AND NOT contains({window(50)}, '>')", 4, "text"),
        "hiding:color_match": hiding(
            "color_match", f"'文字 ' || lower(g1) || ' ≈ 背景 ' || {paper}", ctx(50),
            spans(r"(?:background-)?color\s*:\s*(#\w{3,6}|rgba?\([^)]+\))", "i", (1,)),
            f"NOT starts_with(lower(text), 'background-') AND {paper} != '' AND {alike}"),
        "hiding:absolute_pos": hiding("absolute_pos", "g1 || ':' || g2", ctx(50), spans(V.HIDING_POSITION, "is", (1, 2)),
                                      f"{number.format('g2')} > 1000"),
        "hiding:font_size": hiding("font_size", "text", ctx(50), spans(V.HIDING_FONT, "i")),
        "hiding:text_indent": hiding("text_indent", "g1", ctx(50), spans(V.HIDING_INDENT, "i", (1,)),
                                     f"{number.format('g1')} > 50"),
        # One more character is taken instead of looking ahead, and left off again.
        "hiding:opacity": hiding(
            "opacity", "cut", ctx(50, stop="start + length(cut)"),
            "(SELECT *, regexp_extract(text, '(?i)^opacity[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]*:"
            "[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]*0(?:\\.0+)?') AS cut FROM "
            + spans(r"opacity\s*:\s*(?:0\.0+|0)(?:[^.\d]|$)", "i") + ")"),
        "hiding:visibility": hiding("visibility", "'visibility: hidden'", ctx(50), spans(V.HIDING_VISIBILITY, "i")),
        "hiding:display_none": hiding("display_none", "'display: none'", ctx(50), spans(V.HIDING_DISPLAY, "i")),
        "hiding:nested": hiding("nested", "'多层嵌套'", ctx(30), spans(V.HIDING_NESTED, "i"), severity=4,
                                source_type="html"),
        "hiding:entities": hiding("entities", "n || ' 个 HTML 实体'", ctx(20), stretch(spans(V.NUMERIC_ENTITY, "i"), 6),
                                  "n > 10", 4, "html"),
    }


def keywords() -> str:
    """Every keyword against every page of the corpus."""
    table = ", ".join(f"({plain(k)}, {w})" for k, _, w in built_in_keywords())

    def size(part):
        return f"coalesce(list_sum(list_transform({part}, lambda y: length(y))), 0)"

    # Keywords hold no pattern characters; lower case is as long as the text it comes from.
    source = f"""(SELECT *, CAST({size('g[1:i]')} AS INT) + (i - 1) * length(word) AS start,
                         CAST({size('g[1:i]')} AS INT) + i * length(word) AS stop
                  FROM (SELECT *, unnest(range(1, len(g))) AS i FROM (
                      SELECT page_id, location, content, word, weight,
                             string_split(lower(content), lower(word)) AS g
                      FROM corpus JOIN (VALUES {table}) k(word, weight)
                        ON contains(lower(content), lower(word)))))"""
    return row("('keyword:' || word)", "weight", "keyword_match", "text", "word", f"left({ctx(60)}, 200)", source=source)


# --- URLs ------------------------------------------------------------------------------

def netloc(url: str) -> str:
    return f"lower(regexp_extract({url}, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1))"


def port(url: str) -> str:
    text = rf"regexp_extract(regexp_replace({netloc(url)}, '^.*@', ''), '^[^:]*:([0-9]+)$', 1)"
    return f"CASE WHEN try_cast({text} AS INT) <= 65535 THEN try_cast({text} AS INT) END"


def web(url: str) -> str:
    return f"(starts_with({url}, 'http://') OR starts_with({url}, 'https://'))"


def within(domain: str, hosts) -> str:
    return "(" + " OR ".join(f"{domain} = {plain(h)} OR ends_with({domain}, {plain('.' + h)})" for h in hosts) + ")"


def tld(domain: str) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({domain}, {plain('.' + t)}) THEN {plain(t)}" for t in V.SUSPICIOUS_TLDS) + " END"


def weight(name: str) -> str:
    return "CASE " + name + " " + " ".join(f"WHEN {plain(t)} THEN {w}" for t, w in V.SUSPICIOUS_TLDS.items()) + " ELSE 0 END"


def away(domain: str, base: str) -> str:
    """Neither the base domain nor below it."""
    return f"NOT ({domain} = {base} OR ends_with({domain}, '.' || {base}))"


def score(*pairs) -> str:
    return "(" + " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p in pairs) + ")"


def why(*pairs) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in pairs) + ")"


def urls() -> str:
    """Distinct URLs per page with their first place."""
    shapes = [V.URL_HTTP, r"/[-\w.?%&=#][-\w./?%&=#]*", V.URL_JAVASCRIPT, V.URL_DATA]
    every = " UNION ALL ".join(f"SELECT page_id, location, content, text AS url, start, stop, {i} AS pattern_no "
                               f"FROM {spans(p, 'i')}" for i, p in enumerate(shapes))
    first = f"""(SELECT * FROM ({every}) WHERE length(url) >= 3
                 QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY pattern_no, start) = 1)"""
    return f"""(SELECT *, {window(50)} AS context FROM (SELECT f.* FROM {first} f
        LEFT JOIN (SELECT page_id, list(url) AS known FROM {first} WHERE starts_with(url, 'http') GROUP BY page_id) w
        USING (page_id)
        WHERE NOT (starts_with(url, '/') AND coalesce(len(list_filter(known, lambda k: contains(k, url))), 0) > 0)))"""


def url_table() -> str:
    """URLs with what the rules ask about them."""
    domain = netloc("url")
    words = f"lower(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1))"
    return f"""(SELECT *, {tld('domain')} AS tld, {within('domain', V.TRUSTED_CDN)} AS cdn,
            {first_word('words', V.QUERY_WORDS)} AS word,
            length(string_split(domain, '.')[-2]) >= 8 AND NOT regexp_matches(string_split(domain, '.')[-2], '[0-9]') AS odd,
            coalesce({port('url')} NOT IN (0, {items(V.STANDARD_PORTS)}), false) AS odd_port
        FROM (SELECT *, {domain} AS domain, {netloc('location')} AS base, {words} AS words FROM {urls()}))"""


def url_rules() -> dict:
    table = url_table()
    short = f"domain IN ({items(V.SHORT_LINK_DOMAINS)})"
    far = f"base != '' AND domain != '' AND {away('domain', 'base')}"
    facts = [(far, 2, plain(V.REASON_EXTERNAL_LINK)),
             ("tld IS NOT NULL", weight("tld"), f"{plain(V.REASON_TLD)} || tld"),
             ("coalesce(odd, false)", 2, plain(V.REASON_RANDOM_DOMAIN)),
             (short, 3, plain(V.REASON_SHORT)), ("odd_port", 2, plain(V.REASON_PORT)),
             ("word IS NOT NULL", 1, f"{plain(V.REASON_QUERY)} || word")]
    js, data = "starts_with(lower(url), 'javascript:')", "starts_with(lower(url), 'data:')"
    http = "(starts_with(lower(url), 'http://') OR starts_with(lower(url), 'https://'))"
    total = score(*[(c, p) for c, p, _ in facts])
    risk = (f"CASE WHEN {js} THEN 8 WHEN {data} THEN CASE WHEN length(url) > 500 THEN 5 ELSE 4 END "
            f"WHEN NOT {http} OR cdn THEN 0 ELSE {total} END")
    reasons = (f"CASE WHEN {js} THEN {plain(V.REASON_JS_PSEUDO)} WHEN {data} THEN {plain(V.REASON_DATA)} "
               f"ELSE {why(*[(c, t) for c, _, t in facts])} END")
    named = f"regexp_matches(url, {rx(V.RANDOM_JS_NAME)})"

    def arm(rule, severity, source_type, reasons, where, evidence="url"):
        return row(rule, severity, "suspicious_url", source_type, evidence, "context", reasons=reasons, source=table,
                   where=where)

    return {
        "html:suspicious_url": arm("html:suspicious_url", f"least(10, {risk})", "html", reasons, f"({risk}) > 0"),
        "css:url:javascript": arm("css:url:javascript", 5, "css", plain(V.REASON_CSS_JS), "starts_with(url, 'javascript:')"),
        "css:url:data": arm("css:url:data", "CASE WHEN length(url) > 500 THEN 5 ELSE 4 END", "css", plain(V.REASON_DATA),
                            "starts_with(url, 'data:')", "left(url, 200)"),
        "css:url:external": arm("css:url:external", 2, "css", plain(V.REASON_CSS_EXTERNAL),
                                f"domain != '' AND {web('url')} AND NOT cdn"),
        "js:dynamic_url": arm(
            "js:dynamic_url", f"least(5, least(5, 3 + {weight('tld')}) + CASE WHEN {named} THEN 1 ELSE 0 END)", "js",
            why(("true", plain(V.REASON_JS_EXTERNAL)), ("tld IS NOT NULL", f"{plain(V.REASON_JS_TLD)} || tld"),
                (named, plain(V.REASON_JS_RANDOM))),
            f"domain != '' AND CASE WHEN base = '' THEN {web('url')} ELSE {away('domain', 'base')} END"),
    }


def url_risk(url: str) -> tuple[str, str]:
    """Risk and reasons of one URL on its own."""
    kind, domain = f"lower(regexp_extract({url}, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1))", netloc(url)
    path = rf"regexp_replace(regexp_extract({url}, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '')"
    odd_port = f"coalesce({port(url)} NOT IN (0, {items(V.STANDARD_PORTS)}), false)"
    named, short = f"regexp_matches({path}, {rx(V.RANDOM_SCRIPT_NAME)})", within(domain, V.SHORT_LINK_DOMAINS)
    bad = f"({tld(domain)}) IS NOT NULL"
    risk = f"least(10, {score((f'{kind} = {plain('javascript')}', 5), (f'{kind} = {plain('data')}', 4), (f'{kind} IN ({items(['http', 'https'])})', 1), (odd_port, 2), (bad, 2), (short, 3), (named, 1))})"
    reasons = why((f"{kind} = 'javascript'", plain(V.REASON_JS_PSEUDO)), (f"{kind} = 'data'", plain(V.REASON_DATA)),
                  (odd_port, plain(V.REASON_PORT)), (bad, f"{plain(V.REASON_TLD)} || {tld(domain)}"),
                  (short, plain(V.REASON_SHORT)), (named, plain(V.REASON_RANDOM_PATH)))
    return risk, reasons


# --- element tree ------------------------------------------------------------------------

def attr(name: str, tag: str = "tag") -> str:
    return f"regexp_extract({tag}, '(?s)\\s{name}=\"([^\"]*)\"', 1)"


def tags(name: str) -> str:
    """Start tags of one element name outside comments, with the text up to their end tag."""
    clean = "(SELECT page_id, location, regexp_replace(content, '(?s)<!--.*?-->', '', 'g') AS content FROM corpus)"
    whole = (rf"<{name}\b[^>]*>" if name == "input" else rf"(?s)<{name}\b[^>]*>.*?</{name}>")
    return f"""(SELECT page_id, location, whole, regexp_extract(whole, '^<[^>]*>') AS tag,
                       replace(whole, '<input', '<input') AS outer_html, {netloc('location')} AS base
                FROM (SELECT page_id, location, unnest(regexp_extract_all(content, {plain(whole)})) AS whole FROM {clean}))"""


STYLED = ["a", "b", "i", "u", "em", "p", "div", "span", "article", "iframe"]


def dom_rules() -> dict:
    def dom(name, severity, category, evidence, source, where, reasons="''", cut=300, context=None):
        context = context or f"left({serialised('whole')}, {cut})"
        return row(f"html:dom:{name}", severity, category, "html", evidence, context, False, reasons, source, where)

    def serialised(text):
        # Void elements are written with a closing slash.
        return f"regexp_replace({text}, '(<input[^>]*[^/])>', '\\1/>', 'g')"

    src, href, action, style = attr("src"), attr("href"), attr("action"), f"lower({attr('style')})"
    scripts, frames, links, forms = tags("script"), tags("iframe"), tags("a"), tags("form")
    body = "regexp_extract(whole, '(?s)^<[^>]*>(.*)</script>$', 1)"
    link_domain, link_text = netloc(href), "regexp_replace(whole, '<[^>]*>', '', 'g')"
    hiding = [(f"(contains({style}, 'display:none') OR contains({style}, 'visibility:hidden'))", "css"),
              (f"(contains({style}, 'opacity:0') OR contains({style}, 'opacity: 0'))", "opacity"),
              (f"regexp_matches({style}, 'font-size\\s*:\\s*0')", "font"),
              (f"regexp_matches({style}, '(?:left|top)\\s*:\\s*-\\d{{3,}}px')", "offscreen"),
              (f"{attr('aria-hidden')} = 'true'", "aria")]
    usable = f"{web(href)} AND NOT {within(link_domain, V.TRUSTED_CDN)}"
    bait = ("(" + " OR ".join(f"contains(lower({link_text}), {plain(w)})" for w in V.BAIT_WORDS) + ") AND NOT ("
            + " OR ".join(f"contains({link_domain}, {plain(w)})" for w in V.NEUTRAL_DOMAIN_WORDS) + ")")
    facts = [(f"base != '' AND {away(link_domain, 'base')}", 2, plain(V.REASON_EXTERNAL_LINK)),
             (f"({tld(link_domain)}) IS NOT NULL", weight(f"({tld(link_domain)})"), f"{plain(V.REASON_TLD)} || {tld(link_domain)}"),
             (f"{link_domain} IN ({items(V.SHORT_LINK_DOMAINS)})", 3, plain(V.REASON_SHORT)),
             (bait, 2, plain(V.DOM_BAIT_REASON))]
    risk = score(*[(c, p) for c, p, _ in facts])
    frame_domain = netloc(src)
    far = f"base != '' AND {away(frame_domain, 'base')}"
    named = f"({tld(frame_domain)}) IS NOT NULL"
    fields = f"""(SELECT page_id, location, unnest(regexp_extract_all(whole, '<input[^>]*>')) AS tag FROM {forms})"""
    hidden_field = f"{attr('type')} = 'hidden'"
    field_name, field_value = f"lower({attr('name')})", f"lower({attr('value')})"
    shown_field = f"left({serialised('tag')}, 200)"
    bare = f"replace(lower({attr('style')}), ' ', '')"
    joined = "array_to_string(list_filter(string_split(" + attr("class") + ", ' '), lambda x: x != ''), ' ')"

    def styled(name, severity, where):
        return union(*[dom(name, severity, "hidden_element", "left(whole, 200)", tags(t), where) for t in STYLED])

    return {
        "html:dom:external_script": dom(
            "external_script", 4, "suspicious_url", src, scripts,
            f"{web(src)} AND {netloc(src)} != '' AND NOT {within(netloc(src), V.TRUSTED_CDN)}"),
        "html:dom:no_sri": dom("no_sri", 2, "suspicious_pattern", src, scripts, f"{web(src)} AND {attr('integrity')} = ''"),
        "html:dom:suspicious_inline_script": dom(
            "suspicious_inline_script", 5, "js_issue", f"left({body}, 200)", scripts,
            f"{src} = '' AND regexp_matches({body}, '(?i)\\b(eval|document\\.write|fromCharCode)\\s*\\(')",
            context=f"left({body}, 300)"),
        "html:dom:iframe": dom(
            "iframe", f"least(10, {score(('true', 3), (far, 2), (named, weight(f'({tld(frame_domain)})')))})",
            "suspicious_url", src, frames, web(src),
            why(("true", plain(V.DOM_IFRAME_REASON)), (far, plain(V.DOM_IFRAME_REASON_EXTERNAL)),
                (named, f"{plain(V.REASON_TLD)} || {tld(frame_domain)}"))),
        "html:dom:hidden_iframe": dom(
            "hidden_iframe", 7, "hidden_element", "left(whole, 200)", frames,
            f"contains({style}, 'display:none') OR contains({style}, 'visibility:hidden') OR (contains({style}, 'width') "
            f"AND contains({style}, 'height') AND contains({style}, '0')) OR {attr('width')} IN ('0', '1') "
            f"OR {attr('height')} IN ('0', '1')"),
        "html:dom:no_sandbox": dom("no_sandbox", 2, "suspicious_pattern", src, frames, f"{web(src)} AND {attr('sandbox')} = ''"),
        "html:dom:hidden_link": dom("hidden_link", 6, "hidden_element", href, links,
                                    f"{usable} AND ({' OR '.join(c for c, _ in hiding)})"),
        "html:dom:suspicious_link": dom(
            "suspicious_link", f"least(10, {risk})", "suspicious_url", href, links, f"{usable} AND {risk} >= 4",
            why(*[(c, t) for c, _, t in facts])),
        "html:dom:external_form": dom(
            "external_form", f"CASE WHEN base != '' AND {netloc(action)} != '' AND {netloc(action)} != base THEN 7 ELSE 4 END",
            "suspicious_pattern", action, forms, web(action), cut=500),
        "html:dom:sensitive_hidden_field": dom(
            "sensitive_hidden_field", 3, "suspicious_pattern", shown_field, fields,
            f"{hidden_field} AND ({' OR '.join(f'contains({field_name}, {plain(w)})' for w in V.DOM_SENSITIVE_NAMES)})",
            context=field_name),
        "html:dom:suspicious_hidden_value": dom(
            "suspicious_hidden_value", 5, "suspicious_pattern", shown_field, fields,
            f"{hidden_field} AND (contains({field_value}, 'http') OR contains({field_value}, 'script'))",
            context=field_value),
        "html:dom:insecure_login": dom(
            "insecure_login", 6, "suspicious_pattern",
            f"'Password field on HTTP page, action=' || coalesce(nullif({action}, ''), '(none)')", forms,
            "starts_with(location, 'http://') AND contains(whole, 'type=\"password\"')", cut=400),
        "html:dom:styled_hidden": styled(
            "styled_hidden", 3, f"contains({bare}, 'display:none') OR contains({bare}, 'visibility:hidden')"),
        "html:dom:zero_opacity": styled(
            "zero_opacity", 4, f"contains({bare}, 'opacity:0') AND NOT contains({bare}, 'display:none')"),
        "html:dom:offscreen_positioned": styled(
            "offscreen_positioned", 5, f"regexp_matches({bare}, '(?:left|top)\\s*:\\s*-\\d{{3,}}px')"),
        "html:dom:hidden_attribute": union(*[dom(
            "hidden_attribute", 2, "hidden_element", "left(whole, 200)", tags(t), "regexp_matches(tag, '\\shidden[=>]')")
            for t in STYLED]),
        "html:dom:hiding_class": union(*[dom(
            "hiding_class", 3, "hidden_element", f"'class=\"' || {joined} || '\"'", tags(t),
            " OR ".join(f"contains(lower({joined}), {plain(w)})" for w in V.DOM_HIDING_CLASSES)) for t in STYLED]),
    }


def all_arms() -> dict:
    return {**html_texts(), **js_texts(), **css_texts(), **hiding_texts(), "keyword": keywords(), **url_rules(),
            **dom_rules()}
