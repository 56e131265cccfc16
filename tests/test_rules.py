"""One-line pages and what must, or must not, be found in them."""

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagescan import custom_rules, detect, scan, scan_errors
from pagescan.functions.linear import Pattern, matcher
from pagescan.operators import catalog as C
from pagescan.operators.textrules import entropy_findings, extract_urls, text_findings
from pagescan.rules import values as V

@pytest.fixture
def rng():
    return random.Random(11)


FILL = "words without any markup at all that keep a distance "
# (page, {rule: count}) -- a count of 0 means the rule must stay silent.
CASES = [
    ('<i onfocus="javascript:eval (q)">.</i>', {"html:suspicious_url": 1, "css:url:javascript": 1, "html:pattern:eval_inline": 1,
                                               "html:pattern:suspicious_attributes": 1}),
    ("go to https://node7.gq/z now", {"html:suspicious_url": 1, "css:url:external": 1, "js:dynamic_url": 1}),
    ('<script src="https://lib.cdn.bootcdn.net/v.js"></script>',
     {"html:suspicious_url": 0, "css:url:external": 0, "html:dom:external_script": 0, "html:dom:no_sri": 1, "js:dynamic_url": 1}),
    ('<section style="margin:0;display:none;color:red">q</section>', {"html:hidden_element": 1, "html:dom:styled_hidden": 1,
                                                                      "css:hiding:display": 1, "hiding:display_none": 1}),
    ("<meta http-equiv=refresh content='3;url=/next'>", {"html:meta:refresh": 1}),
    ("<!-- todo: move the private notes -->", {"html:comment:hidden_content": 1}),
    ('<!-- see <u href="http://old.example/9">it</u> -->', {"html:comment:link": 1}),
    ("<h1>Tea &amp; bread</h1><p class='menu'>Open from nine to five.</p>", {"html:suspicious_url": 0, "html:dom:hiding_class": 0,
                                                                            "html:dom:hidden_attribute": 0}),
    # Frames: a width of one is hidden, of two is not; a sandbox needs a value.
    ('<iframe src="http://f.example/" width="1"></iframe>', {"html:dom:hidden_iframe": 1, "html:dom:no_sandbox": 1}),
    ('<iframe src="http://f.example/" width="2" sandbox=""></iframe>', {"html:dom:hidden_iframe": 0, "html:dom:no_sandbox": 1}),
    ('<iframe src="http://f.example/" sandbox="x"></iframe>', {"html:dom:no_sandbox": 0, "html:dom:iframe": 1}),
    # Three digits are off the screen, two are not.
    ('<a href="http://l.example/1" style="top:-100px">q</a>', {"html:dom:hidden_link": 1, "html:dom:offscreen_positioned": 1}),
    ('<a href="http://l.example/1" style="top:-99px">q</a>', {"html:dom:hidden_link": 0, "html:dom:offscreen_positioned": 0}),
    ('<form action="http://collect.example/"><input name=q></form>', {"html:dom:external_form": 1}),
    ('<form><input name="my_Key_7" type="hidden"></form><input name="my_Key_7" type="hidden">', {"html:dom:sensitive_hidden_field": 1}),
    ('<input type="hidden" name="credential">', {"html:dom:sensitive_hidden_field": 0}),
    ("<td hidden=until-found>q</td>", {"html:dom:hidden_attribute": 1}),
    ('<b class="n sr-only-focusable">q</b><b class="hi de">q</b>', {"html:dom:hiding_class": 1}),
    ("<p style='opacity&#58;0'>s</p>", {"html:dom:zero_opacity": 1}),
    ("one​two three⁠four", {"hiding:zero_width": 1}),
    # Ten blanks are a run, nine are not; markup within fifty characters excuses any number.
    (FILL * 2 + "\t" * 10 + FILL * 2, {"hiding:whitespace": 1}),
    (FILL * 2 + "\t" * 8 + "q" + FILL * 2, {"hiding:whitespace": 0}),
    ("<b>" + "q" * 49 + " " * 10 + FILL, {"hiding:whitespace": 0}),
    ("<b>" + "q" * 50 + " " * 10 + FILL, {"hiding:whitespace": 1}),
    (".t{color:#000} .u{background-color : black}", {"hiding:color_match": 1}),
    (".t{color:#0a0b0c;background-color:#0a0b0d}", {"hiding:color_match": 0}),
    (".t{color:#fff" + "}" * 200 + "background-color:#fff}", {"hiding:color_match": 0}),
    ("q{position:absolute; bottom : 1001}", {"hiding:absolute_pos": 1}),
    ("q{position:absolute; bottom : -1000}", {"hiding:absolute_pos": 0}),
    ("font-size: 1px; text-indent: -50px; opacity: 0.01", {"hiding:font_size": 0, "hiding:text_indent": 0, "hiding:opacity": 0}),
    ("font-size: 0; text-indent: -51%; opacity: 0.00;", {"hiding:font_size": 1, "hiding:text_indent": 1, "hiding:opacity": 1}),
    ("<p><a name=q> <span>inner</span></a></p>", {"hiding:nested": 1}),
    ("".join(f"&#{i};" for i in range(65, 76)), {"hiding:entities": 1}),
    ("".join(f"&#{i};" for i in range(65, 75)), {"hiding:entities": 0}),
    (r"\x41" * 5 + r"A" * 4, {"js:obfuscation:hex_encoding": 1, "js:obfuscation:unicode_encoding": 0}),
    ("appendChild(x); y.innerHTML = 1", {"js:high_risk:appendChild": 1, "js:dom:appendChild": 1, "js:high_risk:innerHTML": 0}),
    ("// hack it\n/* stealth exploit */", {"js:comment:suspicious": 2, "css:comment:suspicious": 1}),
    ("a{opacity:0.00}", {"css:hiding:opacity": 3}),
    (".ab{left:-99999px}", {"css:hiding:absolute_pos": 1}),
    (".a{left:-99999px}", {"css:hiding:absolute_pos": 0}),
    (".averyveryveryverylongname{}", {"css:selector:long_class": 1}),
    ("@import 'a';" * 10, {"css:import:excessive": 0}),
    ("@import 'http://a.com/x';" * 11, {"css:import:excessive": 1, "css:import:external": 11}),
    ("\x01" * 10, {"css:obfuscation:control_chars": 0}),
    ("\x01" * 11, {"css:obfuscation:control_chars": 1}),
    ("", {"html:suspicious_url": 0}),
    ("在线赌博网站", {"keyword:赌博": 1, "keyword:赌博网站": 1, "keyword:在线赌博": 1}),
]


@pytest.fixture(scope="module")
def found(pages):
    rows = scan(pages(*[text for text, _ in CASES])).select("page_id", "rule_id").collect()
    return Counter((r.page_id, r.rule_id) for r in rows)


@pytest.mark.parametrize("number", range(len(CASES)))
def test_case(found, number):
    for rule, count in CASES[number][1].items():
        assert found[number, rule] == count, (CASES[number][0], rule)


def test_plain_rules_find_what_re_finds_on_all_prepared_pages(spark):
    """Every single-pattern rule against a Python loop over the same whole pages."""
    from oracle.corpus import seeded_pages
    corpus = seeded_pages(spark, "/root/testdata/sf0.001").cache()
    rules = [r for r in (*C.HTML, *C.JS, *C.CSS, *C.HIDING) if r.kind == "plain"]
    got = Counter((r.page_id, r.rule_id, r.context) for r in text_findings(corpus, rules).collect())
    expected = Counter()
    for page in corpus.collect():
        for rule in rules:
            pattern = (r"\b" if rule.before else "") + rule.pattern
            for m in re.finditer(pattern, page.content, re.I if "i" in rule.flags else 0):
                around = page.content[max(0, m.start() - rule.margin):m.end() + rule.margin]
                expected[page.page_id, rule.key, around.replace("\n", " ").replace("\r", " ")] += 1
    assert got == expected


def test_rewritten_patterns_equal_their_plain_forms(pages):
    css = ["a .b{x:1;left:-100px} c{top:-5px}", "no braces here at all left:-100px", "#x{a{top:-1000%;left:-200em}",
           "a{b}left:-100px{c}.d{left:-300px}right:-400px e{", ".{left:-100px} x y{bottom:-123456em;z}", "x{left:-100px;top:-200px}"]
    plain = r"\.?[#\w][^{]+\{[^}]*(?:left|top|right|bottom)\s*:\s*-(\d{3,})(?:px|em|%)"
    rule = [r for r in C.CSS if r.key == "css:hiding:absolute_pos"]
    got = Counter((r.page_id, r.evidence, r.pos_start, r.pos_end, r.severity) for r in text_findings(pages(*css), rule).collect())
    assert got == Counter((i, m.group(0), m.start(), m.end(), 4 if int(m.group(1)) > 9999 else 3)
                          for i, text in enumerate(css) for m in re.finditer(plain, text, re.I | re.S))
    position = ["position:absolute left:5px position:absolute top:-2000.5em tail position:absolute", "POSITION : absolute\n\nright: 1001"]
    plain = r"position\s*:\s*absolute.*?(left|top|bottom|right)\s*:\s*(-?\d+(?:\.\d+)?(?:px|em|%)?)"
    rule = [r for r in C.HIDING if r.key == "hiding:absolute_pos"]
    got = Counter((r.page_id, r.evidence) for r in text_findings(pages(*position), rule).collect())
    assert got == Counter((i, f"{m.group(1)}:{m.group(2)}") for i, text in enumerate(position)
                          for m in re.finditer(plain, text, re.I | re.S)
                          if abs(float(re.search(r"[-\d.]+", m.group(2)).group(0))) > 1000)
    lines = "\n".join(["x=[1].join('') [2].join(\"\")", "[no", "y [a][b].join (\n'q') [c].join('')"] * 3)
    rule = [r for r in C.JS if r.key == "js:obfuscation:array_join"]
    got = [r.evidence for r in text_findings(pages(lines), rule).collect()]
    assert got == [V.EVIDENCE_MATCHES % len(re.findall(r"\[.*\]\.join\s*\(\s*[\"']", lines))]


def test_linear_patterns_equal_re_on_random_text(pages):
    """Text over each pattern's own pieces, so that matches, near misses and open ends all occur."""
    pieces = {
        "html:pattern:data_uri": ["data:", ";", "base64,", ";base64,", "a", "DATA:"],
        "html:pattern:remote_iframe": ["<iframe", ">", " src=", '"', "http://", "https://x", " "],
        "html:pattern:obfuscated_attributes": ["on", "data-", "a", "=", '"', r"\\x41", r"\\u0041", " ", "é", "-"],
        "html:hidden_element": ["<div", "<p", " style=", '"', "'", "display:none", "visibility : hidden", ">", "x"],
        "html:meta:refresh": ["<meta", " http-equiv=", "refresh", '"', " content=", "0;url=", "x", " ", ">"],
        "js:pattern:self_executing": ["function", "(", ")", "{", "}", "()", "a", " "],
        "js:pattern:conditional_eval": ["if", "(", ")", "{", "}", "eval(", "a", " "],
        "js:pattern:try_catch_eval": ["try {", "}", "eval(", ")", "} catch", "{", "a"],
        "js:pattern:hidden_eval": ["a = 'eval'", "a", ";", "[", "] (", "]", "\n"],
        "css:selector:attr_js": ["[", "]", "=", "javascript:", "data:", "a"],
        "css:property:bg_ext": ["url(", "http://", ")", "a", "'", " "],
        "css:property:content_after": [":after", "{", "}", "content:", "'data:", "a", " "],
        "css:property:content_before": [":before", "{", "}", "content :", '"javascript:', "a"],
        "hiding:nested": ["<div", "<p", "<a", ">", " ", "<", "x", "\n"],
        "css:hiding:absolute_pos": ["{", "}", "a", "#", ".", "left:-100px", "top : -12345em", ";", " "],
    }
    rng = random.Random(3)
    rules = {r.key: r for r in (*C.HTML, *C.JS, *C.CSS, *C.HIDING) if r.linear}
    assert set(rules) == set(pieces)
    for key, parts in pieces.items():
        rule = rules[key]
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(400)]
        got = matcher([Pattern(rule.pattern, rule.flags, rule.groups, rule.before)])
        frame = pages(*texts)
        rows = frame.select("page_id", got(F.col("content"), F.lit(1)).alias("m")).collect()
        flags = sum({"i": re.I, "s": re.S}[f] for f in rule.flags)
        hits = 0
        for r in rows:
            want = [m.span() for m in re.finditer((r"\b" if rule.before else "") + rule.pattern, texts[r.page_id], flags)]
            at, spans = 0, []
            for gap, found in zip(r.m.p0.gaps, r.m.p0.found) if r.m.p0 else ():
                spans.append((at + len(gap), at + len(gap) + len(found)))
                at = spans[-1][1]
            assert spans == want, (key, texts[r.page_id])
            hits += len(want)
        assert hits > 2, key


def test_a_batch_is_looked_at_and_given_back_in_slices():
    import pyarrow as pa
    from pagescan.functions import linear
    texts = ["ab" * 400] * 3_000 + [None, "", "a" * 3 * linear.SLICE_BYTES] + ["x"] * 1_200 + ["ba"]
    run = matcher([Pattern("a")], (linear.Fact("size", "int", pa.int32(), lambda t: [len(x) for x in t.to_pylist()]),)).func
    asked = pa.array([0 if t is None else 3 for t in texts], pa.int64())
    out = list(run(iter([(pa.array(texts, pa.string()), asked), (pa.array([], pa.string()), pa.array([], pa.int64()))])))
    rows = [row for part in out for row in part.to_pylist()]
    assert max(map(len, out)) <= linear.SLICE_ROWS and [r["size"] for r in rows] == [t if t is None else len(t) for t in texts]
    assert [r["p0"] and len(r["p0"]["found"]) for r in rows] == [t.count("a") or None if t else None for t in texts]


# Beginnings without their ends, and many of what a rule has to compare with each other.
HOSTILE = {
    "attribute selector": "[=" * 50_000 + "data:", "try": "try{eval()" * 10_000 + "catch", "data address": "data:" * 20_000 + ";base64,",
    "frame": "<iframe " * 12_000 + "src=", "attribute": "onx=" * 25_000 + r"\\x", "style": "<div " * 20_000 + "style=display",
    "meta": "<meta " * 16_000 + "http-equiv=refresh content=", "function": "(function" * 11_000 + ")()", "if": "if(" * 33_000 + "eval(",
    "index": "a='eval';[" * 10_000, "block": "a{" * 50_000 + ":-100px", "after": ":after{" * 14_000 + "content", "nested": "<div" * 25_000 + "<span",
    "css address": "url(http://" * 9_000, "comment": "/* " * 33_000, "comments": "/* // a\n" * 12_000, "line comment": "//\n" * 33_000 + "/*",
    "links": "<a>" * 33_000, "ends": "</x>" * 25_000 + "<div>" * 20_000, "html comment": "<!--" * 25_000, "data": "data:;" * 16_000 + ";base64,",
    "open end": "</x " * 25_000 + "://", "quote": "<b x='" * 16_000 + "eval",
    "open colour": "color:rgb( " * 9_000 + "background-color", "colours": "color:rgb(1 " * 9_000 + "background-color:#000; color:#000;" * 500,
    "all marks": "".join(map(chr, range(0xE000, 0xF900))) * 8 + "data:;base64,x",
    "keywords": "赌博" * 25_000, "addresses": "".join(f"http://h{i}.xyz/{i} " for i in range(3_000)),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_cost_no_more_than_their_length(pages, name):
    """Four times the page takes about four times as long, eight times for many matches, whose offsets grow with the power
    1.5; sixteen times would be the square.  Each page by itself, so that none hides behind the others."""
    def seconds(text):
        begin = time.perf_counter()
        scan(pages(text)).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin
    text = HOSTILE[name]
    once = seconds(text[:len(text) // 4])
    whole = seconds(text)
    assert whole < 8 * once + 3, (once, whole)


def test_addresses_and_paths_of_a_page_are_not_compared_pair_by_pair(pages):
    def seconds(n):
        text = "".join(f"http://h{i}.example/a{i}/b{i} /a{i}/b{i} /c{i} " for i in range(n))
        begin = time.perf_counter()
        rows = extract_urls(pages(text)).count()
        assert rows == 2 * n
        return time.perf_counter() - begin
    seconds(100)
    half, whole = seconds(25_000), seconds(50_000)  # 1.2 and 2.5 megabytes
    assert whole < 2.6 * half + 2, (half, whole)


def test_paths_inside_addresses_are_those_that_in_says(pages, rng):
    texts = []
    for _ in range(300):
        parts = []
        for _ in range(rng.randrange(12)):
            path = "".join(rng.choice(["/", "a", "b", ".", "/a", "?x=1"]) for _ in range(rng.randrange(2, 7)))
            parts.append(rng.choice(["http://h.x", "HTTP://h.x", "https://", "", ""]) + path)
        texts.append(" ".join(parts))
    got = {}
    for r in extract_urls(pages(*texts)).collect():
        got.setdefault(r.page_id, set()).add(r.url)
    for i, text in enumerate(texts):
        seen = []
        for pattern in (V.URL_HTTP, V.URL_PATH, V.URL_JAVASCRIPT, V.URL_DATA):
            for m in re.finditer(pattern, text, re.I):
                url = m.group(0)
                if len(url) < 3 or url in seen or url.startswith("/") and any(url in u for u in seen if u.startswith("http")):
                    continue
                seen.append(url)
        assert got.get(i, set()) == set(seen), text


def test_text_colours_are_those_that_re_finds(rng):
    import pyarrow as pa
    from pagescan.operators.textrules import _colors
    parts = ["color", "background-", ":", " ", "#fff", "#12", "#abcdef0", "rgb(", "rgba(", ")", "1,2", "COLOR:", "color:#", "é"]
    hits = 0
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        want = [(m.start(), m.end(), m.group(1), text[max(0, m.start() - 200):m.start()], text[m.end():m.end() + 200])
                for m in re.finditer(V.TEXT_COLOR, text, re.I)]
        got = _colors(pa.array([text]))[0]
        assert [(r["start"], r["stop"], r["g1"], r["before"], r["after"]) for r in got] == want, text
        hits += len(want)
    assert hits > 200 and _colors(pa.array([None, ""])) == [[], []]


def test_keywords_are_those_that_re_finds(pages, rng):
    """Nested, overlapping and repeated keywords of many letters, against a search for each."""
    from pagescan.rules.loaders import keyword_table
    letters = "aAbBkKsSſiıİK赌博ßẞΣςσ ._é\U0001f600"
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) for _ in range(150)} - {" ", "  ", "   "}
    words = sorted(w for w in words if w.strip())
    table = keyword_table([(w, "other", 1 + i % 10) for i, w in enumerate(words)])
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(150)]
    got = Counter((r.page_id, r.evidence, r.pos_start, r.pos_end, r.severity) for r in text_findings(pages(*texts), [C.KEYWORD], table).collect())
    want = Counter()
    for n, text in enumerate(texts):
        for i, w in enumerate(words):
            literal = re.escape(w)
            pattern = rf"(?<!\w){literal}(?!\w)" if re.fullmatch("[A-Za-z]{1,2}", w) else literal
            for m in re.finditer(pattern, text, re.I):
                want[n, w, m.start(), m.end(), 1 + i % 10] += 1
    assert got == want and sum(want.values()) > 500


def test_very_many_keywords(pages, monkeypatch):
    from pagescan.operators import keywords as W
    from pagescan.rules.loaders import keyword_table
    def seconds(n, frame):
        table = keyword_table([(f"word{i}x", "other", 5) for i in range(n)])
        begin = time.perf_counter()
        found = text_findings(frame, [C.KEYWORD], table)
        found.explain()
        planned = time.perf_counter() - begin
        assert found.count() == 2 * 40
        return planned, time.perf_counter() - begin - planned
    frame = pages(*[("word7x and WORD240X " + FILL * 300)] * 40)
    seconds(300, frame)
    _, few = seconds(300, frame)
    planned, many = seconds(50_000, frame)
    assert planned < 2 and many < 2 * few + 2, (planned, few, many)
    monkeypatch.setattr(W, "MOST_CHARS", 500)
    seconds(300, frame)


def test_entropy(pages):
    rows = {r.page_id: r for r in entropy_findings(pages("aaaa", "".join(map(chr, range(33, 65))), "abcdefghijklmnop",
                                                         "", "// " + "".join(map(chr, range(33, 90))))).collect()}
    assert set(rows) == {1, 2}
    assert (rows[1].rule_id, rows[1].severity, rows[1].evidence) == ("js:entropy:high", 4, "熵值 5.00")
    assert (rows[2].rule_id, rows[2].metadata["entropy"]) == ("js:entropy:medium", "4.0")


def test_modes_and_detectors(pages):
    page = pages("<script>eval(1)</script> https://evil.xyz/a.js .averyveryverylongname{} 赌博 <p style='display:none'>x</p>")
    kinds = {mode: {r.rule_id.split(":")[0] for r in scan(page, mode).collect()} for mode in ("fast", "standard", "deep")}
    assert kinds["fast"] == {"html", "keyword"}
    assert kinds["deep"] == kinds["standard"] == {"html", "keyword", "js", "css", "hiding"}
    for name in kinds["deep"]:
        assert {r.rule_id.split(":")[0] for r in detect(page, name).collect()} == {name}


def test_a_whole_scan_reads_the_pages_once(spark, tmp_path, capsys):
    spark.range(4).selectExpr("id AS page_id", "'x' AS location", "'<p>' AS content").write.parquet(str(tmp_path / "p"))
    for mode in ("fast", "deep"):
        scan(spark.read.parquet(str(tmp_path / "p")), mode).explain("formatted")
        plan = capsys.readouterr().out
        tree = plan[:plan.index("\n(1) ")]
        assert tree.count("Scan parquet") == 1 and tree.count("ArrowEvalPython") == 1 and "MapInArrow" not in tree
    rules = custom_rules([{"rule_id": f"r{i}", "pattern": rf"w{i}\b"} for i in range(30)])
    for frame in (scan(spark.read.parquet(str(tmp_path / "p")), rules=rules), scan(spark.read.parquet(str(tmp_path / "p")), rules=rules, errors=True),
                  scan_errors(spark.read.parquet(str(tmp_path / "p")), rules)):
        frame.explain("formatted")
        plan = capsys.readouterr().out
        assert plan[:plan.index("\n(1) ")].count("Scan parquet") == 1


def test_metadata_and_reasons(pages):
    rows = {r.rule_id: r for r in scan(pages("eval(x) https://evil.xyz/ <p style='color:red;display:none'>")).collect()}
    assert rows["js:high_risk:eval"].metadata == {"function": "eval"}
    assert rows["html:pattern:eval_inline"].metadata["pattern"] == "eval_inline"
    assert rows["css:hiding:display"].metadata == {"property": "display", "value": "none"}
    assert rows["hiding:display_none"].metadata == {"technique": "显示隐藏"}
    assert rows["html:suspicious_url"].reasons == ["外部链接", "高风险域名后缀 .xyz"]
