"""Registered queries: one per operator, each over a whole table, with comparison SQL."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oracle import arms as A
from oracle.corpus import corpus_sql, plain, seeded_pages
from pagescan.functions import urls as U
from pagescan.functions.text import lit
from pagescan.operators import catalog as C
from pagescan.operators import rollups as R
from pagescan.operators.custom import custom_findings
from pagescan.operators.detectors import page_detector
from pagescan.operators.dom import dom_findings, elements
from pagescan.operators.rendered import cloaked_findings, rendered_findings
from pagescan.operators.textrules import entropy_findings, extract_urls, text_findings
from pagescan.plans.run import counters, scan_targets
from pagescan.plans.scan import detect, scan, scan_errors, union
from pagescan.rules import values as V
from pagescan.rules.loaders import (
    built_in_keywords, clean_custom_rules, clean_keywords, custom_rules, keyword_table)
from pagescan.schema import finding, to_findings
from pagescan.sources import files as FS
from pagescan.sources.folders import shared_folder
from pagescan.sources import pages as P
from pagescan.sources import reports as S

QUERIES, ORACLE = {}, {}
_ARMS = A.all_arms()


def flat(findings: DataFrame) -> DataFrame:
    """Findings as plain columns."""
    return findings.selectExpr("page_id", "location", "rule_id", "severity", "category", "source_type", "evidence",
                               "context", "pos_start", "pos_end", "array_join(reasons, '|') AS reasons")


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = sql


def on_corpus(build):
    return lambda spark, sf: build(seeded_pages(spark, sf))


def table(name):
    return lambda spark, sf: spark.read.parquet(f"{sf}/{name}.parquet")


def rule_query(name, rules, arms, condition=None):
    """Findings of some rules; ``condition`` picks one of several a pattern serves."""
    def build(pages):
        found = text_findings(pages, rules)
        return flat(found if condition is None else found.where(condition))

    register(name, on_corpus(build), A.with_corpus(A.union(*[_ARMS[a] for a in arms])))


def _by_key(rules, key):
    return [next(r for r in rules if r.key == key)]


# --- text rules ----------------------------------------------------------------------------

for _n, (_name, *_rest) in enumerate(V.HTML_PATTERNS, 1):
    rule_query(f"htm{_n}_{_name}", _by_key(C.HTML, f"html:pattern:{_name}"), [f"html:pattern:{_name}"])
rule_query("htm8_hidden_element", _by_key(C.HTML, "html:hidden_element"), ["html:hidden_element"])
for _n, (_name, *_rest) in zip((9, 10, 11), V.HTML_COMMENT_RULES):
    register(f"htm{_n}_comment_{_name}",
             on_corpus(lambda pages, name=_name: flat(text_findings(pages, _by_key(C.HTML, "html:comment")).where(
                 f"rule_id = 'html:comment:{name}'"))),
             A.with_corpus(A.only(_ARMS["html:comment:rules"], f"rule_id = 'html:comment:{_name}'")))
rule_query("htm13_comment_link", _by_key(C.HTML, "html:comment"), ["html:comment:link"],
           "rule_id = 'html:comment:link'")
rule_query("htm14_meta_refresh", _by_key(C.HTML, "html:meta:refresh"), ["html:meta:refresh"])

rule_query("js1_high_risk_calls", [r for r in C.JS if r.kind == "js_call"], [f"js:high_risk:{f}" for f in V.JS_HIGH_RISK],
           "startswith(rule_id, 'js:high_risk:')")
for _n, (_name, *_rest) in enumerate(V.JS_OBFUSCATION, 2):
    rule_query(f"js{_n}_{_name}", _by_key(C.JS, f"js:obfuscation:{_name}"), [f"js:obfuscation:{_name}"])
for _n, (_name, *_rest) in enumerate(V.JS_PATTERNS, 8):
    rule_query(f"js{_n}_{_name}", _by_key(C.JS, f"js:pattern:{_name}"), [f"js:pattern:{_name}"])
rule_query("js15_dom_operations", [r for r in C.JS if r.kind == "js_call"], [f"js:dom:{f}" for f in V.JS_DOM_OPERATIONS],
           "startswith(rule_id, 'js:dom:')")
rule_query("js16_line_comment", _by_key(C.JS, "js:line_comment"), ["js:comment:line"])
rule_query("js17_block_comment", [C.BLOCK_COMMENT], ["js:comment:block"], "rule_id = 'js:comment:suspicious'")
rule_query("js18_comment_base64", [C.BLOCK_COMMENT], ["js:comment:base64"], "rule_id = 'js:comment:base64'")
register("js19_entropy", on_corpus(lambda pages: flat(entropy_findings(pages))), A.with_corpus(_ARMS["js:entropy"]))
register("js19_entropy_documents", lambda spark, sf: flat(entropy_findings(table("documents")(spark, sf).selectExpr(
    "doc_id AS page_id", "source AS location", "text AS content"))),
    "WITH corpus AS (SELECT doc_id AS page_id, source AS location, text AS content FROM documents)\n" + _ARMS["js:entropy"])

rule_query("css1_hiding_values", [r for r in C.CSS if r.kind == "css_value"], [f"css:hiding:{p}" for p in V.CSS_HIDING_VALUES])
rule_query("css2_absolute_pos", _by_key(C.CSS, "css:hiding:absolute_pos"), ["css:hiding:absolute_pos"])
for _n, (_name, *_rest) in enumerate(V.CSS_SELECTORS, 3):
    rule_query(f"css{_n}_{_name}", _by_key(C.CSS, f"css:selector:{_name}"), [f"css:selector:{_name}"])
for _n, (_name, *_rest) in enumerate(V.CSS_PROPERTIES, 6):
    rule_query(f"css{_n}_{_name}", _by_key(C.CSS, f"css:property:{_name}"), [f"css:property:{_name}"])
for _n, _key in ((10, "import:external"), (11, "import:excessive"), (13, "obfuscation:long_names"),
                 (14, "obfuscation:control_chars")):
    rule_query(f"css{_n}_{_key.replace(':', '_')}", _by_key(C.CSS, f"css:{_key}"), [f"css:{_key}"])
rule_query("css12_comment_words", [C.BLOCK_COMMENT], ["css:comment:suspicious"], "rule_id = 'css:comment:suspicious'")

for _n, _rule in enumerate(C.HIDING, 1):
    rule_query(f"hid{_n}_{_rule.key.split(':')[1]}", [_rule], [_rule.key])
_COUNTING = [r for r in (*C.JS, *C.CSS, *C.HIDING) if r.kind in ("js_count", "css_count", "zero_width", "entities")]
rule_query("agg8_count_rules", _COUNTING, [r.key for r in _COUNTING])

# --- URLs -----------------------------------------------------------------------------------

_SHORT_REASON = A.url_risk("url")


def url_query(name, spark_columns, sql_columns):
    register(name, on_corpus(lambda pages: extract_urls(pages).selectExpr("page_id", "location", "url", *spark_columns)),
             A.with_corpus(f"SELECT page_id, location, url, {sql_columns} FROM {A.urls()}"))


url_query("url1_extract_domain", [f"{U.netloc('url')} AS domain"], f"{A.netloc('url')} AS domain")
url_query("url2_is_external_link",
          [f"{U.is_external_link('url')} AS absolute", f"{U.is_external_link('url', U.netloc('location'))} AS external"],
          f"({A.netloc('url')} != '' AND {A.web('url')}) AS absolute, ({A.netloc('url')} != '' AND "
          f"{A.away(A.netloc('url'), A.netloc('location'))}) AS external")
url_query("url3_is_trusted_cdn", [f"{U.is_trusted_cdn('url')} AS trusted"],
          f"{A.within(A.netloc('url'), V.TRUSTED_CDN)} AS trusted")
url_query("url4_extract_urls", ["context", "pos_start", "pos_end", "pattern_no"],
          "context, start AS pos_start, stop AS pos_end, pattern_no")
url_query("url5_url_risk", [f"{U.url_risk('url')}.risk_level AS risk_level",
                            f"array_join({U.url_risk('url')}.reasons, '|') AS reasons"],
          f"{_SHORT_REASON[0]} AS risk_level, {_SHORT_REASON[1]} AS reasons")
register("url5_url_risk_raw_pages", lambda spark, sf: table("pages")(spark, sf).selectExpr(
    "page_id", "url", f"{U.url_risk('url')}.risk_level AS risk_level", f"array_join({U.url_risk('url')}.reasons, '|') AS reasons"),
    f"SELECT page_id, url, {_SHORT_REASON[0]} AS risk_level, {_SHORT_REASON[1]} AS reasons FROM pages")
url_query("url7_random_domain", [f"{U.random_domain(U.netloc('url'))} AS random_domain"],
          f"coalesce(length(string_split({A.netloc('url')}, '.')[-2]) >= 8 AND NOT "
          f"regexp_matches(string_split({A.netloc('url')}, '.')[-2], '[0-9]'), false) AS random_domain")
url_query("url8_odd_port", [f"{U.port('url')} AS port", f"{U.odd_port('url')} AS odd_port"],
          f"{A.port('url')} AS port, coalesce({A.port('url')} NOT IN (0, 80, 443, 8080, 8443), false) AS odd_port")
url_query("url9_query_word", [f"{U.query_word('url')} AS word"],
          A.first_word(r"lower(regexp_extract(url, '^[^?#]*\?([^#]*)', 1))", V.QUERY_WORDS) + " AS word")
for _name, _rules in (("url6_html_suspicious_url", ["html:suspicious_url"]),
                      ("url10_css_urls", ["css:url:javascript", "css:url:data", "css:url:external"]),
                      ("url11_js_dynamic_url", ["js:dynamic_url"])):
    rule_query(_name, [C.URL], _rules, f"rule_id IN ({', '.join(map(lit, _rules))})")
register("set3_distinct_urls", on_corpus(lambda pages: extract_urls(pages).groupBy("page_id").agg(
    F.count("*").alias("urls"), F.count_distinct("url").alias("distinct_urls"))),
    A.with_corpus(f"SELECT page_id, count(*) AS urls, count(DISTINCT url) AS distinct_urls FROM {A.urls()} GROUP BY page_id"))

# --- element tree ------------------------------------------------------------------------------

_RAW = "|".join(rf"<{t}\b[^>]*>.*?(?:</{t}|\Z)" for t in ("script", "style", "textarea", "title"))
_MARKUP = (rf"<!--.*?(?:--!?>|\Z)|{_RAW}|<[a-z][^\s/>]*(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>|<[!?/][^>]*>")
register("dom0_elements", on_corpus(lambda pages: elements(pages).selectExpr(
    "page_id", "elem_no", "tag", "begin", "coalesce(attrs['style'], '') AS style")), A.with_corpus(
        "SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY start) - 1 AS INT) AS elem_no, "
        "lower(regexp_extract(text, '^<([a-zA-Z][^\\s/>]*)', 1)) AS tag, start AS begin, "
        "regexp_extract(regexp_extract(text, '^<[^>]*>'), '\\sstyle=\"([^\"]*)\"', 1) AS style "
        f"FROM {A.spans(_MARKUP, 'is')} WHERE regexp_matches(text, '^<[a-zA-Z]')"))
for _n, _name in enumerate((
        "external_script", "no_sri", "suspicious_inline_script", "iframe", "hidden_iframe", "no_sandbox", "hidden_link",
        "suspicious_link", "external_form", "sensitive_hidden_field", "suspicious_hidden_value", "insecure_login",
        "styled_hidden", "zero_opacity", "offscreen_positioned", "hidden_attribute", "hiding_class"), 1):
    register(f"dom{_n}_{_name}", on_corpus(lambda pages, name=_name: flat(
        dom_findings(pages).where(f"rule_id = 'html:dom:{name}'"))), A.with_corpus(_ARMS[f"html:dom:{_name}"]))

# --- keywords and user rules -----------------------------------------------------------------------

_BUILT_IN = keyword_table(built_in_keywords())
register("key1_keywords", on_corpus(lambda pages: flat(text_findings(pages, [C.KEYWORD], _BUILT_IN))),
         A.with_corpus(_ARMS["keyword"]))

_SHORT_WORDS = [("la", "other", 5), ("de", "porn", 6), ("th", "other", 7), ("es", "malware", 8)]
_BOUND = r"[^\p{L}\p{N}_]"
register(
    "key2_short_words", on_corpus(lambda pages: text_findings(pages, [C.KEYWORD], keyword_table(_SHORT_WORDS)).groupBy(
        "page_id", "rule_id").agg(F.count("*").alias("hits"))),
    # Separators are doubled, so that neighbouring words need not share one.
    A.with_corpus(f"""SELECT page_id, 'keyword:' || w AS rule_id, len(hits) AS hits FROM (
        SELECT page_id, w, regexp_extract_all(regexp_replace(content, '({_BOUND})', '\\1\\1', 'g'),
                                              '(?i)(?:^|{_BOUND})' || w || '(?:{_BOUND}|$)') AS hits
        FROM corpus, (VALUES ('la'), ('de'), ('th'), ('es')) k(w)) WHERE len(hits) > 0"""))
_REPEATED = [("赌博", "gambling", 10), ("webshell", "malware", 9), ("赌博", "other", 1), ("登录", "nonsense", 6)]
_CATEGORY = "CASE w {} END".format(" ".join(f"WHEN {plain(w)} THEN {plain(V.KEYWORD_CATEGORIES.get(c, '其他'))}"
                                             for w, c, _ in reversed(_REPEATED) if (w, c) != ("赌博", "other")))
register(
    "key3_first_listed_wins", on_corpus(lambda pages: text_findings(pages, [C.KEYWORD], keyword_table(_REPEATED)).groupBy(
        "page_id", "evidence", "severity").agg(F.count("*").alias("hits"))),
    A.with_corpus("""SELECT page_id, w AS evidence, s AS severity, len(string_split(lower(content), w)) - 1 AS hits
        FROM corpus, (VALUES ('赌博', 10), ('webshell', 9), ('登录', 6)) k(w, s) WHERE contains(lower(content), w)"""))
register(
    "key4_category_names", on_corpus(lambda pages: text_findings(pages, [C.KEYWORD], keyword_table(_REPEATED)).selectExpr(
        "page_id", "evidence", "metadata['category'] AS category_name").distinct()),
    A.with_corpus(f"""SELECT page_id, w AS evidence, {_CATEGORY} AS category_name
        FROM corpus, (VALUES ('赌博'), ('webshell'), ('登录')) k(w) WHERE contains(lower(content), w)"""))


def _ranked_keywords(pages):
    return R.ranked_keywords(text_findings(pages, [C.KEYWORD], _BUILT_IN)).select(
        "page_id", "evidence", "severity", "pos_start", "rank")


register("key5_by_severity", on_corpus(_ranked_keywords), A.with_corpus(
    "SELECT page_id, evidence, severity, pos_start, row_number() OVER (PARTITION BY page_id "
    f"ORDER BY severity DESC, pos_start, evidence) AS rank FROM ({_ARMS['keyword']})"))

# Rules of a user's own, for what rules can hold: a back-reference, a look-behind, a look-ahead, lines, alternatives, a repeated
# group; severities beyond both ends; some for the linear engine, some not.  With each goes the part that the other engine
# cannot say: a plain form of the pattern, and a condition.
SAMPLE_RULES = [
    ({"rule_id": "shape:word_twice", "pattern": r"(赌博)\1", "severity": 14, "category": "keyword_match",
      "description": "the same word twice"}, "赌博赌博", "true"),
    ({"rule_id": "shape:ink", "pattern": r"(?<!-)color ?: ?#[0-9a-f]{3}\b", "flags": "i", "severity": 2, "source_type": "css",
      "description": "short colours of text"}, r"color ?: ?#[0-9a-f]{3}\b", "substring(content, start, 1) != '-'"),
    ({"rule_id": "shape:far_side", "pattern": r"(?:left|right|top) ?: ?-\d{4,}(?:px|em)", "flags": "i", "severity": -3,
      "category": "css_issue", "source_type": "css"}, None, "true"),
    ({"rule_id": "shape:plain_host", "pattern": r"https?://(?!x\.)[a-z0-9]+\.(?:xyz|ml)\b", "severity": 4, "category": "suspicious_url",
      "source_type": "html"}, r"https?://[a-z0-9]+\.(?:xyz|ml)\b", "NOT contains(text, '//x.')"),
    ({"rule_id": "shape:statement", "pattern": r"^[a-z]+\(\);", "flags": "m", "severity": 3, "source_type": "js"}, None, "true"),
    ({"rule_id": "shape:pairs", "pattern": r"(?:[A-Z][0-9]){3,}", "severity": 6}, None, "true"),
    ({"rule_id": "shape:over_lines", "pattern": r"Secret.lines", "flags": "is"}, None, "true"),
]


def _custom_arm(rule, pattern=None, where="true"):
    return A.row(rule["rule_id"], max(1, min(10, rule.get("severity", 5))), rule.get("category", "suspicious_pattern"),
                 rule.get("source_type", "text"), "left(text, 200)", A.ctx(80),
                 source=A.spans(pattern or rule["pattern"], rule.get("flags", "")), where=where)


# In the one pass of a scan, with the rules of the catalog.
register("cus1_user_rules", on_corpus(lambda pages: flat(scan(pages, "fast", rules=custom_rules([r for r, *_ in SAMPLE_RULES])).where(
    "startswith(rule_id, 'shape:')"))), A.with_corpus(A.union(*[_custom_arm(*r) for r in SAMPLE_RULES])))
_FLAGGED = [{"rule_id": "flag:i", "pattern": "EVAL", "flags": "i"}, {"rule_id": "flag:none", "pattern": "EVAL"},
            {"rule_id": "flag:s", "pattern": r"exploit.{1,5}backdoor", "flags": "sx"},
            {"rule_id": "flag:m", "pattern": r"^code\(\);.*$", "flags": "m", "severity": 99},
            {"rule_id": "flag:nothing", "pattern": r"exploit.{1,5}backdoor"}]
register("cus2_flags", on_corpus(lambda pages: flat(custom_findings(pages, custom_rules(_FLAGGED)))),
         A.with_corpus(A.union(*[_custom_arm(r) for r in _FLAGGED])))


class OpenBody:
    """A detector of a user's own: pages that stop before their body ends.  It fails on pages that cannot be fetched twice."""

    def detect(self, content, location):
        if "Secret" in content:
            raise LookupError(location)
        if "</body>" not in content:
            yield {"rule_id": "user:no_body_end", "severity": 0, "source_type": "html", "evidence": content[-20:]}


# Findings and errors of one scan.
register("udf1_user_detector", on_corpus(lambda pages: flat(scan(pages, "fast", extra=[page_detector(OpenBody())], errors=True).where(
    "rule_id IN ('user:no_body_end', '#detector')"))), A.with_corpus(A.union(
        A.row("user:no_body_end", 1, "suspicious_pattern", "html", "right(content, 20)", placed=False, source="corpus",
              where="NOT contains(content, '</body>') AND NOT contains(content, 'Secret')"),
        A.row("#detector", 0, "error", "", "'OpenBody: LookupError: ' || location", placed=False, source="corpus",
              where="contains(content, 'Secret')"))))

# --- sources ---------------------------------------------------------------------------------------

register("src1_scan_pages", lambda spark, sf: P.web_pages(table("pages")(spark, sf)),
         "SELECT page_id, url AS location, html AS content FROM pages WHERE html IS NOT NULL")

# A file tree laid over the pages: folders, names and endings follow from page_id.
_ENDINGS = V.HTML_EXTENSIONS + V.CSS_EXTENSIONS + V.JS_EXTENSIONS + [".png", ".TXT", ".HTML", ""]
_PATH = ("'/site/' || CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'a/' WHEN 2 THEN 'a/b/c/' WHEN 3 THEN 'a/b/c/d/' "
         "ELSE '.git/' END || CASE page_id % 11 WHEN 0 THEN '.' WHEN 1 THEN 'old/' ELSE '' END || 'p' || page_id || "
         "CASE page_id % {} {} END").format(
             len(_ENDINGS), " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_ENDINGS)))


def _paths(spark, sf):
    return table("pages")(spark, sf).selectExpr("page_id", f"{_PATH} AS path", "html")


def _taken_sql(mode, where="true"):
    endings = ", ".join(plain(e) for e in P.extensions(mode))
    return (f"SELECT page_id, path FROM (SELECT page_id, {_PATH} AS path FROM pages) WHERE "
            f"regexp_extract(lower(path), '[^/.][^/]*?(\\.[^./]*)$', 1) IN ({endings}) AND {where}")


# Encoded addresses of a store with a host; locations keep it.
register("src3_directory_scan", lambda spark, sf: _paths(spark, sf).selectExpr(
    "page_id", "concat('s3a://bucket/my%20files', path) AS uri").selectExpr("page_id", f"{FS.location('uri')} AS path").where(
        FS.selected("path", "s3a://bucket/my files/site")),
    "SELECT page_id, 's3a://bucket/my files' || path AS path FROM ("
    + _taken_sql("deep", "NOT contains(path, '/.') AND len(string_split(path, '/')) - 3 <= 3") + ")")
_EXCLUDE = ["*/old/*", "*.min.js", "/site/a/b/", "*p?.js"]
register("src4_exclude_patterns", lambda spark, sf: _paths(spark, sf).where(
    f"NOT {FS.excluded('path', _EXCLUDE)}").select("page_id", "path"),
    f"SELECT page_id, path FROM (SELECT page_id, {_PATH} AS path FROM pages) WHERE NOT (path GLOB '*/old/*' "
    "OR path GLOB '*.min.js' OR starts_with(path, '/site/a/b') OR path GLOB '*p?.js')")
register("src7_mode_extensions", lambda spark, sf: union([
    _paths(spark, sf).where(P.has_extension("path", mode)).selectExpr("page_id", "path", f"'{mode}' AS mode")
    for mode in ("fast", "deep")]), " UNION ALL ".join(
        f"SELECT page_id, path, '{mode}' AS mode FROM ({_taken_sql(mode)})" for mode in ("fast", "deep")))


def _files(spark, sf):
    """Pages as raw files; some get a NUL, some control bytes, some another charset, some nothing."""
    return _paths(spark, sf).selectExpr("page_id", "path AS location", """CASE page_id % 7
        WHEN 0 THEN concat(X'00', CAST(html AS BINARY)) WHEN 1 THEN concat(unhex(repeat('01', 400)), CAST(html AS BINARY))
        WHEN 2 THEN concat(unhex(repeat('02', 300)), CAST(html AS BINARY)) WHEN 3 THEN concat(X'D6D0CEC4', CAST('<p>' AS BINARY))
        WHEN 4 THEN X'' ELSE CAST(html AS BINARY) END AS content""")


# Bytes 1 and 2 are the only ones outside text that these files hold.
register("src5_binary_filter", lambda spark, sf: _files(spark, sf).selectExpr(
    "page_id", "location", f"{FS.is_binary('content')} AS is_binary"),
    f"""SELECT page_id, {_PATH} AS location, CASE page_id % 7 WHEN 0 THEN true
        WHEN 1 THEN 400 / least(1024, 400 + octet_length(encode(html))) > 0.3
        WHEN 2 THEN 300 / least(1024, 300 + octet_length(encode(html))) > 0.3 ELSE false END AS is_binary FROM pages""")
register("src6_decode", lambda spark, sf: FS.decode_files(_files(spark, sf)).selectExpr(
    "page_id", "location", "charset", "length(content) AS chars", "md5(CAST(content AS BINARY)) AS digest"),
    f"""SELECT page_id, {_PATH} AS location, CASE WHEN page_id % 7 = 3 THEN 'gb18030' ELSE 'utf-8' END AS charset,
        CAST(CASE page_id % 7 WHEN 0 THEN 1 + length(html) WHEN 1 THEN 400 + length(html) WHEN 2 THEN 300 + length(html)
             WHEN 3 THEN 5 WHEN 4 THEN 0 ELSE length(html) END AS INT) AS chars,
        md5(CASE page_id % 7 WHEN 0 THEN unhex('00') || encode(html) WHEN 1 THEN unhex(repeat('01', 400)) || encode(html)
            WHEN 2 THEN unhex(repeat('02', 300)) || encode(html) WHEN 3 THEN encode('中文<p>') WHEN 4 THEN encode('')
            ELSE encode(html) END) AS digest FROM pages""")
register("src2_scan_files", lambda spark, sf: flat(text_findings(
    FS.file_pages(_files(spark, sf).drop("page_id")), _by_key(C.CSS, "css:obfuscation:control_chars"))).drop("page_id"),
    f"""SELECT {_PATH} AS location, 'css:obfuscation:control_chars' AS rule_id, 3 AS severity, 'css_issue' AS category,
        'css' AS source_type, '300 个控制字符' AS evidence, '' AS context, 0 AS pos_start, 0 AS pos_end, '' AS reasons
        FROM pages WHERE page_id % 7 = 2 AND 300 / least(1024, 300 + octet_length(encode(html))) <= 0.3""")

_TARGET = ("CASE page_id % 6 WHEN 0 THEN '  ' || url || ' ' WHEN 1 THEN 'http://192.168.1.' || page_id || ':80/x' "
           "WHEN 2 THEN 'https://172.' || (page_id % 40) || '.0.1/' WHEN 3 THEN '   ' "
           "WHEN 4 THEN '/site/p' || page_id || '.html' ELSE '/site/d' || page_id || ' ' END")
_KIND = r"""CASE WHEN starts_with(target, 'http://') OR starts_with(target, 'https://') THEN
    CASE WHEN regexp_matches(string_split(string_split(target, '/')[3], ':')[1],
        '^(127\.0\.0\.1|localhost|10\.\d+\.\d+\.\d+|172\.(?:1[6-9]|2\d|3[01])\.\d+\.\d+|192\.168\.\d+\.\d+)$')
    THEN 'internal_url' ELSE 'external_url' END
    WHEN regexp_matches(target, '\.[^./]+$') THEN 'local_file' ELSE 'local_directory' END"""
_TARGETS = f"(SELECT trim(t) AS target FROM (SELECT {_TARGET} AS t FROM pages) WHERE trim(t) != '')"
register("src8_target_list", lambda spark, sf: P.clean_targets(table("pages")(spark, sf).selectExpr(f"{_TARGET} AS value")),
         f"SELECT target FROM {_TARGETS}")
register("src9_target_types", lambda spark, sf: P.classify_targets(P.clean_targets(
    table("pages")(spark, sf).selectExpr(f"{_TARGET} AS value"))), f"SELECT target, {_KIND} AS target_type FROM {_TARGETS}")

_RAW_WORD = ("CASE page_id % 9 WHEN 0 THEN '# note' WHEN 1 THEN ' ' ELSE ' word' || page_id END AS keyword",
             "CASE page_id % 4 WHEN 0 THEN ' porn' WHEN 1 THEN 'unknown' ELSE 'phishing' END AS category",
             "CASE page_id % 6 WHEN 0 THEN '99' WHEN 1 THEN '-3' WHEN 2 THEN 'x' WHEN 3 THEN NULL WHEN 4 THEN ' 7 ' "
             "ELSE CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE '2.5' END END AS weight")
register("src10_keyword_rows", lambda spark, sf: clean_keywords(table("pages")(spark, sf).selectExpr(*_RAW_WORD)),
    f"""SELECT trim(keyword) AS keyword, CASE WHEN trim(category) IN ('gambling', 'porn', 'malware', 'phishing', 'other')
        THEN trim(category) ELSE 'other' END AS category,
        CASE WHEN regexp_matches(trim(weight), '^[+-]?[0-9]+$') THEN greatest(1, least(10, CAST(trim(weight) AS INT)))
        ELSE 5 END AS weight FROM (SELECT {', '.join(_RAW_WORD)} FROM pages)
        WHERE weight IS NOT NULL AND trim(keyword) != '' AND NOT starts_with(trim(keyword), '#')""")
register("src12_user_rule_rows", lambda spark, sf: clean_custom_rules(table("pages")(spark, sf).selectExpr(
    "IF(page_id % 5 = 0, NULL, concat('r', page_id)) AS rule_id", "url AS pattern", "IF(page_id % 2 = 0, 'i', NULL) AS flags",
    "CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 11 = 1 THEN 'high' ELSE CAST(page_id - 20 AS STRING) END AS severity", "IF(page_id % 7 = 0, 'js_issue', NULL) AS category",
    "CAST(NULL AS STRING) AS source_type", "CAST(NULL AS STRING) AS description")),
    """SELECT 'r' || page_id AS rule_id, url AS pattern, CASE WHEN page_id % 2 = 0 THEN 'i' ELSE '' END AS flags,
        CASE WHEN page_id % 3 = 0 THEN 5 ELSE greatest(1, least(10, page_id - 20)) END AS severity,
        CASE WHEN page_id % 7 = 0 THEN 'js_issue' ELSE 'suspicious_pattern' END AS category, 'text' AS source_type,
        '' AS description FROM pages WHERE page_id % 5 != 0 AND (page_id % 3 = 0 OR page_id % 11 != 1)""")

# --- rendered pages ------------------------------------------------------------------------------------

_ADDRESS = ("CASE {} % 7 WHEN 0 THEN 'https://evil.xyz:9999/abcdefghij.js' WHEN 1 THEN 'javascript:go()' "
            "WHEN 2 THEN '/local' WHEN 3 THEN 'https://sub.bit.ly/q' WHEN 4 THEN 'data:text/html;base64,QUJD' "
            "WHEN 5 THEN '' ELSE url END")
# Value lists are called array() here and list_value() in the comparison.
_RENDERED = {
    "page_id": "page_id", "location": "url",
    "tag": "CASE page_id % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'DIV' WHEN 2 THEN 'iframe' WHEN 3 THEN 'p' ELSE 'A' END",
    "text": "CASE page_id % 6 WHEN 0 THEN '  ' ELSE ' text of ' || page_id || ' ' END",
    "href": "CASE WHEN page_id % 5 IN (0, 4) THEN " + _ADDRESS.format("page_id") + " END",
    "src": "CASE WHEN page_id % 5 = 2 THEN " + _ADDRESS.format("page_id") + " END",
    "display": "CASE page_id % 8 WHEN 1 THEN 'none' ELSE 'block' END",
    "visibility": "CASE page_id % 8 WHEN 2 THEN 'hidden' ELSE 'visible' END",
    "opacity": "CASE page_id % 8 WHEN 3 THEN '0' WHEN 4 THEN '0.5' ELSE '1' END",
    "position": "CASE page_id % 3 WHEN 0 THEN 'absolute' ELSE 'static' END",
    "left_px": "CAST(CASE page_id % 4 WHEN 0 THEN -2000 WHEN 1 THEN -1000 ELSE 5 END AS INT)",
    "top_px": "CAST(CASE page_id % 9 WHEN 0 THEN -1001 ELSE 0 END AS INT)",
    "width": "CAST(CASE page_id % 10 WHEN 0 THEN 1 ELSE 100 END AS DOUBLE)",
    "height": "CAST(CASE page_id % 12 WHEN 0 THEN 0 ELSE 20 END AS DOUBLE)",
    "font_px": "CAST(CASE page_id % 13 WHEN 0 THEN 0 ELSE 12 END AS INT)",
    "links": "CASE WHEN page_id % 3 = 1 THEN {list}(url, " + _ADDRESS.format("(page_id + 3)") + ") ELSE {list}('') END",
}


def _rendered(spark, sf):
    return table("pages")(spark, sf).selectExpr(*[f"{v.replace('{list}', 'array')} AS {k}" for k, v in _RENDERED.items()])


def _rendered_sql():
    table_sql = ("(SELECT " + ", ".join(f"{v.replace('{list}', 'list_value')} AS {k}" for k, v in _RENDERED.items())
                 + " FROM pages)")
    off = "(position = 'absolute' AND (left_px < -1000 OR top_px < -1000))"
    hidden = (f"({off} OR display = 'none' OR visibility = 'hidden' OR opacity = '0' OR width <= 1 OR height <= 1 "
              "OR font_px <= 0)")
    element = (f"(SELECT *, list_filter(links, lambda l: l != '') AS inside, left(trim(text), 200) AS shown, {off} AS off "
               f"FROM {table_sql} WHERE {hidden})")
    element = f"(SELECT * FROM {element} WHERE len(inside) > 0 OR shown != '')"
    severity, technique = "CASE WHEN len(inside) > 0 THEN 8 ELSE 6 END", "CASE WHEN off THEN 'off_screen' ELSE 'visibility' END"

    def risky(rule, column, context, where):
        risk, reasons = A.url_risk(column)
        return A.row(rule, risk, "suspicious_url", "dynamic", column, context, False, reasons, table_sql,
                     f"{where} AND {column} != '' AND {risk} > 0")

    first, last = V.RENDERED_REASON
    return {
        "ren1_dynamic_link": risky("headless:dynamic_link", "href", f"{plain(V.RENDERED_LINK)} || left(trim(text), 100)",
                                   "lower(tag) = 'a'"),
        "ren2_hidden_element": A.row("headless:hidden_element", severity, "hidden_element", "dynamic",
                                     "'<' || upper(tag) || '>: ' || shown", "shown", False, source=element),
        "ren3_hidden_link": A.row(
            "headless:hidden_link", f"greatest({severity}, {A.url_risk('link')[0]})", "suspicious_url", "dynamic", "link",
            f"{plain(V.RENDERED_HIDDEN_LINK)} || link", False, f"{plain(first)} || {technique} || {plain(last)}",
            f"(SELECT *, unnest(inside) AS link FROM {element})"),
        "ren4_iframe": risky("headless:iframe", "src", "'iframe src: ' || src", "lower(tag) = 'iframe'"),
    }


for _name, _sql in _rendered_sql().items():
    register(_name, lambda spark, sf, rule="headless:" + _name.split("_", 1)[1]: flat(
        rendered_findings(_rendered(spark, sf)).where(f"rule_id = {lit(rule)}")), _sql)


def _cloaked(spark, sf):
    """Crawlers get the prepared pages, browsers the same except every third, which is plain."""
    crawler = seeded_pages(spark, sf)
    original = P.web_pages(table("pages")(spark, sf)).withColumnRenamed("content", "html")
    browser = crawler.join(original.select("page_id", "html"), "page_id").selectExpr(
        "page_id", "location", "IF(page_id % 3 = 0, html, content) AS content")
    return flat(cloaked_findings(text_findings(crawler, C.HIDING), text_findings(browser, C.HIDING)))


_HIDING_SQL = A.union(*[_ARMS[r.key] for r in C.HIDING])
register("ren5_cloaking", _cloaked, f"""WITH crawler AS ({corpus_sql()}),
    browser AS (SELECT c.page_id, c.location, CASE WHEN c.page_id % 3 = 0 THEN html ELSE content END AS content
                FROM crawler c JOIN pages p USING (page_id)),
    seen_as AS ({_HIDING_SQL.replace('FROM corpus', 'FROM crawler')}),
    seen_by AS ({_HIDING_SQL.replace('FROM corpus', 'FROM browser')})
    SELECT {A.COLUMNS} FROM seen_as a WHERE NOT EXISTS (SELECT 1 FROM seen_by b WHERE a.location = b.location
        AND a.rule_id = b.rule_id AND a.evidence = b.evidence)""")

# --- scans, roll-ups, reports ---------------------------------------------------------------------------

_FAST = [k for k in _ARMS if k.startswith("html:") or k == "keyword"]
register("mod2_whole_scan", on_corpus(lambda pages: flat(scan(pages))), A.with_corpus(A.union(*_ARMS.values())))
register("mod1_fast_scan", on_corpus(lambda pages: flat(scan(pages, "fast"))),
         A.with_corpus(A.union(*[_ARMS[k] for k in _FAST])))
for _name in ("css", "hiding", "js"):
    register(f"set1_{_name}_detector", on_corpus(lambda pages, name=_name: flat(detect(pages, name))),
             A.with_corpus(A.union(*[sql for k, sql in _ARMS.items() if k.startswith(f"{_name}:")])))


# Reports and roll-ups are over whole scans.
def _found(spark, sf):
    return scan(seeded_pages(spark, sf))


_FINDINGS = A.union(*_ARMS.values())


def rollup(name, build, columns, group=""):
    register(name, lambda spark, sf: build(_found(spark, sf)), A.with_corpus(f"SELECT {columns} FROM ({_FINDINGS}) f{group}"))


def _count(conditions):
    return ", ".join(f"count(*) FILTER ({c}) AS {name}" for name, c in conditions.items())


_STATISTICS = "count(*) AS total_findings, " + _count({n: f"category = '{c}'" for n, c in R.COUNTED.items()})
_LEVELS = "count(*) AS total, " + _count(R.LEVELS)
_SECTION = f"CASE WHEN category IN ({', '.join(plain(c) for c in R.COUNTED.values())}) THEN category ELSE 'other' END"
rollup("agg1_statistics", R.statistics, _STATISTICS)
rollup("agg2_summary", R.summary, "category, count(*) AS findings", " WHERE category != 'suspicious_pattern' GROUP BY category")
rollup("agg3_severity_histogram", R.severity_histogram, _LEVELS)
rollup("agg4_severity_shares", lambda f: R.severity_shares(f).select(*[
    F.round(c, 6).alias(c) for c in ("critical_share", "high_share", "medium_share", "low_share")]),
    ", ".join(f"round(100.0 * count(*) FILTER ({c}) / count(*), 6) AS {n}_share" for n, c in R.LEVELS.items()))
_RISK = ("CASE WHEN count(*) FILTER (severity >= 8) > 0 THEN '{}' WHEN count(*) FILTER (severity BETWEEN 5 AND 7) > 0 "
         "THEN '{}' WHEN count(*) > 0 THEN '{}' ELSE '{}' END")
rollup("agg5_verdict", R.verdict,
       "count(*) AS total, " + _count({k: R.LEVELS[k] for k in ("critical", "high")})
       + f", {_RISK.format('critical', 'high', 'low', 'clean')} AS risk, {_RISK.format('critical', 'high', 'medium', 'low')}"
       f" AS report_risk, {_RISK.format(*V.VERDICTS.values())} AS wording")


def _page_verdicts(pages):
    return R.page_verdicts(pages, scan(pages))


register("agg5_page_verdicts", on_corpus(_page_verdicts), A.with_corpus(
    "SELECT c.page_id, c.location, "
    + ", ".join(f"coalesce({n}, 0) AS {n}" for n in ("total", *R.LEVELS))
    + ", CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 THEN 'high' WHEN total > 0 THEN 'low' ELSE 'clean' END AS risk"
    + f" FROM corpus c LEFT JOIN (SELECT page_id, {_LEVELS} FROM (" + _FINDINGS
    + ") f GROUP BY page_id) s USING (page_id)"))
rollup("agg7_report_sections", R.sections, f"{_SECTION} AS section, count(*) AS findings, max(severity) AS max_severity",
       f" GROUP BY {_SECTION}")


def _counters(spark, sf):
    files = _files(spark, sf).drop("page_id")
    web = table("pages")(spark, sf).selectExpr("page_id", "url", "IF(page_id % 10 = 0, NULL, html) AS html")
    # A page that could not be fetched counts as scanned, an unreadable file does not.
    scanned = union([FS.file_pages(files).selectExpr("'file' AS kind"), web.selectExpr("'url' AS kind")])
    return R.counters(scanned, union([FS.file_errors(files), P.fetch_errors(web)]))


register("agg6_counters", _counters, """SELECT *, scanned_files + scanned_urls AS total_scanned FROM (SELECT
    count(*) FILTER (page_id % 7 IN (3, 5, 6) OR (page_id % 7 = 1 AND 400 / least(1024, 400 + octet_length(encode(html))) <= 0.3)
        OR (page_id % 7 = 2 AND 300 / least(1024, 300 + octet_length(encode(html))) <= 0.3)) AS scanned_files,
    count(*) AS scanned_urls, count(*) FILTER (page_id % 7 = 4) + count(*) FILTER (page_id % 10 = 0) AS errors FROM pages)""")
register("set2_first_of_location", lambda spark, sf: P.first_of_location(union([
    P.web_pages(table("pages")(spark, sf)),
    table("pages")(spark, sf).selectExpr("page_id + 1000000 AS page_id", "url AS location", "'again' AS content"),
    table("pages")(spark, sf).selectExpr("page_id + 2000000 AS page_id", "'https://hot.example.com/' AS location",
                                         "'hot' AS content"),
    # Equal rows of winners, and pages without a location.
    P.web_pages(table("pages")(spark, sf)),
    table("pages")(spark, sf).selectExpr("page_id + 3000000 AS page_id", "CAST(NULL AS STRING) AS location", "'nowhere' AS content"),
    ])).selectExpr("page_id", "location", "length(content) AS chars"),
    """SELECT page_id, url AS location, length(html) AS chars FROM pages UNION ALL
       SELECT min(page_id) + 2000000, 'https://hot.example.com/', 3 FROM pages UNION ALL
       SELECT min(page_id) + 3000000, NULL, 7 FROM pages""")
register("err1_errors", on_corpus(scan_errors), A.with_corpus(
    f"SELECT location, 'url' AS stage, url AS message FROM {A.urls()} WHERE pattern_no = 0 AND "
    f"{A.port('url')} IS NULL AND regexp_matches(regexp_replace({A.netloc('url')}, '^.*@', ''), '^[^:]*:.')"))

_GUARDED = {c: f"left(CASE WHEN left({c}, 1) IN ('=', '+', '-', '@') THEN '''' || {c} ELSE {c} END, 200)"
            for c in ("evidence", "context")}
rollup("snk1_json_statistics", lambda f: R.statistics(f, ["source_type"]), f"source_type, {_STATISTICS}",
       " GROUP BY source_type")
register("snk2_csv_rows", lambda spark, sf: S.csv_rows(_found(spark, sf)), A.with_corpus(
    "SELECT row_number() OVER (ORDER BY location, page_id, severity DESC, rule_id, pos_start, evidence, context) AS no, "
    "rule_id, category, severity, source_type, location, evidence, context FROM (SELECT page_id, rule_id, category, severity, "
    f"source_type, location, pos_start, {_GUARDED['evidence']} AS evidence, {_GUARDED['context']} AS context FROM ("
    + _FINDINGS + ") f)"))
_GUARD_TABLES = ("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' ELSE '' END"
                 " || text AS value FROM documents")
register("snk3_formula_guard", lambda spark, sf: table("documents")(spark, sf).selectExpr(
    "doc_id", "concat(CASE doc_id % 5 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' ELSE '' END, text) AS value"
    ).selectExpr("doc_id", f"{S.formula_guard('value')} AS value"),
    f"SELECT doc_id, CASE WHEN left(value, 1) IN ('=', '+', '-', '@') THEN '''' || value ELSE value END AS value "
    f"FROM ({_GUARD_TABLES})")
_WORDS = ", ".join(f"({plain(k)}, {plain(V.KEYWORD_CATEGORIES.get(c, V.KEYWORD_CATEGORIES['other']))}, '{w}')" for k, c, w in built_in_keywords())
register("snk4_text_rows", lambda spark, sf: S.text_rows(_found(spark, sf)), A.with_corpus(
    "SELECT category AS section, row_number() OVER (PARTITION BY category ORDER BY location, page_id, severity DESC, rule_id, "
    "pos_start, evidence, context) AS no, evidence, location, severity || '/10' AS severity, "
    "replace(reasons, '|', ', ') AS reasons, left(context, 150) AS context, kind AS keyword_category, weight FROM ("
    + _FINDINGS + f") f LEFT JOIN (VALUES {_WORDS}) k(word, kind, weight) ON category = 'keyword_match' AND evidence = word "
    "WHERE category IN ('suspicious_url', 'keyword_match')"))


def _report_folder(spark, name):
    return f"{shared_folder(spark)}/report-{name}-{uuid.uuid4()}"


def _csv_round_trip(spark, sf):
    """The CSV report as files, read again."""
    folder = _report_folder(spark, "csv")
    S.write_csv(_found(spark, sf), folder)
    names = "no LONG, rule_id STRING, category STRING, severity INT, source_type STRING, location STRING, evidence STRING, context STRING"
    return spark.read.csv(folder, schema=names, header=True, multiLine=True, escape='"', emptyValue="", nullValue="\x00",
                          enforceSchema=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


register("udf3_csv_report", _csv_round_trip, ORACLE["snk2_csv_rows"])


def _json_round_trip(spark, sf):
    """The JSON report's statistics and how many findings stand beside them."""
    folder = _report_folder(spark, "json")
    S.write_json(_found(spark, sf), folder, target="corpus")
    lines = spark.read.json(f"{folder}/findings").groupBy("rule_id").agg(F.count("*").alias("findings"), F.max("severity").alias("severity"))
    total = spark.read.json(f"{folder}/summary").select("statistics.total_findings")
    return lines.withColumn("total_findings", total.scalar())


register("udf3_json_report", _json_round_trip, A.with_corpus(
    "SELECT rule_id, count(*) AS findings, CAST(max(severity) AS BIGINT) AS severity, CAST(sum(count(*)) OVER () AS BIGINT) AS total_findings FROM ("
    + _FINDINGS + ") f GROUP BY rule_id"))


def _run(spark, sf):
    """A scan by a list of addresses, some of which were never fetched: counters and findings of the run."""
    pages = table("pages")(spark, sf)
    targets = pages.selectExpr(f"explode(array(url, {_MISSING})) AS target").where("target IS NOT NULL")
    prepared = seeded_pages(spark, sf).selectExpr("location AS url", "content AS html")
    done = scan_targets(targets, prepared, None, f"{_report_folder(spark, 'run')}", mode="fast")
    totals = done.findings.agg(F.count("*").alias("findings"), F.count_distinct("location").alias("pages_with_findings"))
    return counters(done).withColumns({c: totals.select(c).scalar() for c in totals.columns})


_MISSING = "CASE WHEN page_id % 10 = 3 THEN 'http://gone.example/' || page_id END"
register("mod3_run_of_targets", _run, A.with_corpus(
    f"""SELECT 0 AS scanned_files, count(*) + (SELECT count(*) FROM pages WHERE page_id % 10 = 3) AS scanned_urls,
        count(*) + (SELECT count(*) FROM pages WHERE page_id % 10 = 3) AS total_scanned,
        (SELECT count(*) FROM pages WHERE page_id % 10 = 3) + (SELECT count(*) FROM ({ORACLE['err1_errors']})) AS errors,
        (SELECT count(*) FROM ({A.union(*[_ARMS[k] for k in _FAST])}) f) AS findings,
        (SELECT count(DISTINCT location) FROM ({A.union(*[_ARMS[k] for k in _FAST])}) f) AS pages_with_findings FROM corpus"""))
_TITLE = "CASE section " + " ".join(f"WHEN '{k}' THEN {plain(v)}" for k, v in V.SECTIONS.items()) + " END"
_SECTIONS_SQL = A.with_corpus(
    f"SELECT section, {_TITLE} AS title, no, rule_id, severity, location, "
    "left(evidence, CASE WHEN section IN ('suspicious_url', 'keyword_match') THEN 200 ELSE 120 END) AS evidence, "
    "left(context, CASE WHEN section = 'suspicious_url' THEN 300 ELSE 250 END) AS context FROM (SELECT *, row_number() OVER "
    "(PARTITION BY section ORDER BY severity DESC, location, page_id, rule_id, pos_start, evidence, context) AS no FROM "
    f"(SELECT *, {_SECTION} AS section FROM (" + _FINDINGS + ") f))")
register("snk5_report_sections", lambda spark, sf: S.section_rows(_found(spark, sf)), _SECTIONS_SQL)
register("srt1_sections_by_severity", lambda spark, sf: S.section_rows(_found(spark, sf)).select("section", "no", "severity"),
         f"SELECT section, no, severity FROM ({_SECTIONS_SQL})")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scan, summed up as a verdict per page."""
    pages = seeded_pages(spark, sf_dir)
    return R.page_verdicts(pages, scan(pages))
