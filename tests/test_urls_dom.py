"""URL columns, the element tree, rendered elements, keywords and user rules."""

import pytest
from pyspark.sql import functions as F

from pagescan import custom_rules, load_custom_rules, load_keywords, scan, scan_errors
from pagescan.functions import urls as U
from pagescan.operators import catalog as C
from pagescan.operators.custom import custom_findings
from pagescan.operators.dom import elements, looked_at
from pagescan.operators.rendered import RENDERED, cloaked_findings, rendered_findings
from pagescan.operators.textrules import extract_urls, text_findings
from pagescan.rules.loaders import built_in_keywords, keyword_table
from pagescan.schema import FINDINGS

URLS = [  # url, domain, port, odd port, risk
    ("https://www.example.com/path", "www.example.com", None, False, 1),
    ("http://Example.com:8080/path", "example.com:8080", 8080, False, 1),
    ("javascript:alert(1)", "", None, False, 5),
    ("//example.com/path", "example.com", None, False, 0),
    ("data:text/html;base64,PHN=", "", None, False, 4),
    ("https://evil.xyz/page", "evil.xyz", None, False, 3),
    ("https://evil.xyz:8080/page", "evil.xyz:8080", 8080, False, 1),
    ("https://sub.bit.ly/abc", "sub.bit.ly", None, False, 4),
    ("https://u:p@example.com:9999/p", "u:p@example.com:9999", 9999, True, 3),
    ("https://example.com/abcdefghij.js", "example.com", None, False, 2),
    ("https://example.com/abcdefghij.php;v=1?x#y", "example.com", None, False, 2),
    ("https://example.com:99999/", "example.com:99999", None, False, 1),
    ("https://[2001:db8::1]:81/", "[2001:db8::1]:81", 81, True, 3),
]


def test_url_parts_and_risk(spark):
    rows = spark.createDataFrame([(u,) for u, *_ in URLS], "url STRING").select(
        "url", F.expr(U.netloc("url")), F.expr(U.port("url")), F.expr(U.odd_port("url")),
        F.expr(f"{U.url_risk('url')}.risk_level")).collect()
    assert [tuple(r) for r in rows] == URLS


@pytest.mark.parametrize("url, base, external, trusted", [
    ("https://example.com/p", "example.com", False, False), ("https://sub.example.com/p", "example.com", False, False),
    ("https://notexample.com/p", "example.com", True, False), ("javascript:void(0)", "", False, False),
    ("https://evil.com/", "", True, False), ("https://x.unpkg.com/a", "", True, True), ("https://unpkg.com.evil.com/", "", True, False)])
def test_external_and_cdn(spark, url, base, external, trusted):
    row = spark.createDataFrame([(url, base)], "url STRING, base STRING").select(
        F.expr(U.is_external_link("url", "base")), F.expr(U.is_trusted_cdn("url"))).first()
    assert tuple(row) == (external, trusted)


def test_extract_urls_takes_each_once_and_drops_covered_paths(pages):
    rows = extract_urls(pages("see https://a.com/x/y https://a.com/x/y /x/y /z/w /z/w JavaScript:go() HTTP://B.com/q /q /ab /a")).collect()
    assert sorted((r.url, r.pos_start) for r in rows) == [
        ("/B.com/q", 58), ("/ab", 69), ("/q", 66)][:0] + sorted([
            ("https://a.com/x/y", 4), ("/z/w", 45), ("JavaScript:go()", 55), ("HTTP://B.com/q", 71), ("/B.com/q", 77),
            ("/ab", 89)])


def test_element_tree(pages):
    page = (
        '<FORM action="/a"><input type=hidden name=x><p class=" b  a ">one<p style="x:1">two <b>three</b></form>'
        '<input name="out"><a href="https://e.com/?a=1&amp;b=2" HREF="no">t &lt; <i>u</i><!-- c --></a>'
        '<script>var a = "<p>" && 1;</script><textarea><a href="https://no.com"></textarea>')
    rows = looked_at(pages(page)).collect()
    by_tag = {}
    for row in rows:
        by_tag.setdefault(row.tag, []).append(row)
    assert [r.form_no for r in by_tag["input"]] == [1, None]
    assert by_tag["form"][0].field_types == ["hidden"]
    assert by_tag["p"][0].outer_html == '<p class="b a">one</p>'
    assert by_tag["p"][1].outer_html == '<p style="x:1">two <b>three</b></p>'
    assert len(by_tag["a"]) == 1 and by_tag["a"][0].attrs["href"] == "https://e.com/?a=1&b=2"
    assert by_tag["a"][0].text == "t < u"
    assert by_tag["a"][0].outer_html == '<a href="https://e.com/?a=1&amp;b=2">t &lt; <i>u</i><!-- c --></a>'
    assert by_tag["script"][0].text == 'var a = "<p>" && 1;'
    every = elements(pages(page)).collect()
    assert [r.tag for r in every] == ["form", "input", "p", "p", "b", "input", "a", "i", "script", "textarea"]
    shown = {r.tag: page[r.begin:r.stop] for r in every}
    assert shown["b"] == "<b>three</b>" and shown["p"] == '<p style="x:1">two <b>three</b>' and shown["a"].endswith("<!-- c --></a>")
    assert [r.text for r in every if r.tag == "p"] == ["one", "two "] and every[0].attrs == {"action": "/a"}
    assert every[-1].text == '<a href="https://no.com">' and every[6].text == "t < "


def test_bait_words_inside_nested_links(pages):
    page = "<a>lo<b>gin<a>x<b> verif</b></a>y" + " " * 500 + "<a><b>tail text LOGIN"
    got = [(r.text, r.bait) for r in looked_at(pages(page + "<form>")).collect() if r.tag == "a"]
    assert [b for _, b in got] == [True, False, True] and got[0][0].startswith("loginx verify") and got[2][0] == "tail text LOGIN"


def test_line_ends_inside_addresses(spark):
    frame = spark.createDataFrame([("http://evil.x\nyz/a",), ("ht\ttps://bit.l\ry/q?redir\nect=1",)], "url STRING")
    rows = frame.selectExpr(f"{U.netloc('url')} AS d", f"{U.query_word('url')} AS q", f"{U.scheme('url')} AS s").collect()
    assert [tuple(r) for r in rows] == [("evil.xyz", None, "http"), ("bit.ly", "redirect", "https")]


def test_user_rules_fail_alone(spark, pages):
    from pagescan.operators.catalog import Rule
    from pagescan.operators.custom import custom_findings
    rules = [Rule("good", "abc"), Rule("bad", "(unclosed"), Rule("deep", r"(?:\w|\s){50,}", cut=200), Rule("empty", "q*")]
    frame = pages("abc " * 50_000, "nothing", "")
    found = {(r.page_id, r.rule_id) for r in custom_findings(frame, rules).collect()}
    assert {(0, "good"), (0, "deep"), (1, "empty")} <= found and not any(rule == "bad" for _, rule in found)
    errors = scan_errors(frame, rules).collect()
    assert len(errors) == 3 and all(e.stage == "rule" and e.message.startswith("bad: ") for e in errors)
    assert spark.range(3).count() == 3


def test_rendered_elements(spark):
    rows = [(1, "u", "div", " hi ", None, None, "none", "visible", "1", "static", 0, 0, 10.0, 10.0, 12, ["https://e.xyz/a", "/b"]),
            (2, "u", "p", "far", None, None, "block", "visible", "1", "absolute", -2000, 0, 10.0, 10.0, 12, []),
            (3, "u", "p", " ", None, None, "none", "visible", "1", "static", 0, 0, 10.0, 10.0, 12, []),
            (4, "u", "a", "link", "javascript:go()", None, "block", "visible", "1", "static", 0, 0, 10.0, 10.0, 12, [])]
    found = {(r.page_id, r.rule_id, r.evidence): r for r in rendered_findings(spark.createDataFrame(rows, RENDERED)).collect()}
    assert {k: r.severity for k, r in found.items()} == {
        (1, "headless:hidden_element", "<DIV>: hi"): 8, (1, "headless:hidden_link", "https://e.xyz/a"): 8,
        (1, "headless:hidden_link", "/b"): 8, (2, "headless:hidden_element", "<P>: far"): 6,
        (4, "headless:dynamic_link", "javascript:go()"): 5}
    assert found[2, "headless:hidden_element", "<P>: far"].metadata["technique"] == "off_screen"


def test_cloaking(pages):
    crawler, browser = pages("display:none", "opacity: 0;"), pages("display:none", "nothing")
    rows = cloaked_findings(text_findings(crawler, C.HIDING), text_findings(browser, C.HIDING)).collect()
    assert [r.rule_id for r in rows] == ["hiding:opacity"]


def test_keyword_lists(spark, pages, tmp_path):
    assert len(built_in_keywords()) == 198
    path = tmp_path / "words.csv"
    path.write_text("# note\nAB,other,99\n\nBad Word, porn ,x\nAB,porn,1\nlonely\nÜber,nonsense,3\nx.y,malware,2.5\n", "utf-8")
    words = load_keywords(spark, str(path))
    assert [(w["keyword"], w["category_name"], w["weight"]) for w in words] == [
        ("AB", "其他", 10), ("Bad Word", "色情", 5), ("Über", "其他", 3), ("x.y", "恶意软件", 5)]
    rows = text_findings(pages("ab cab ab1 ÄAB AB. bad word ÜBER xxy x.y"), [C.KEYWORD], words).collect()
    assert sorted((r.evidence, r.pos_start) for r in rows) == [("AB", 0), ("AB", 15), ("Bad Word", 19), ("x.y", 37), ("Über", 28)]
    assert len(load_keywords(spark, str(tmp_path / "none.csv"))) == 198


RULE_PIECES = ["a", "b", "ab", "(a|b)", "(?:ab|é)", "[ab]", "[^a]", r"\d", r"\w", r"\s", r"\b", "^", "$", r"\Z", ".", "a?", "b+", "(?:ab)*", "a{2,3}", "b+?", r"(a)\1",
               "(?=b)", "(?!a)", "(?<=a)", "(?<!b)", "(?>a|ab)", "a++", "(?i:K)", "S", "(?P<n>b)", "x|y", "\n", "İ", "#"]


def test_user_rules_find_what_re_finds(pages):
    """Random patterns of all kinds, in whichever engine they run, against ``re`` on every page."""
    import random
    import re
    from pagescan.operators.custom import linear, required
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "b", "ab", "é", "1", " ", "\n", "k", "K", "ſ", "S", "x", "y", "_", "#", "i", "İ"]) for _ in range(rng.randrange(40)))
             for _ in range(60)] + ["", "a" * 50]
    ascii_only = [t.encode("ascii", "ignore").decode() for t in texts]
    entries = []
    for i in range(250):
        pattern, flags = "".join(rng.choice(RULE_PIECES) for _ in range(rng.randrange(1, 6))), "".join(f for f in "ism" if rng.random() < .3)
        try:
            re.compile(pattern)
        except re.error:
            continue
        entries.append({"rule_id": f"r{i}", "pattern": pattern, "flags": flags})
    rules, every = custom_rules(entries), texts + ascii_only
    engines = {linear(r.pattern, r.flags) for r in rules}
    assert engines == {"yes", "ascii", "no"} and sum(bool(required(r.pattern, r.flags)) for r in rules) > 50
    got = {}
    for r in custom_findings(pages(*every), rules).collect():
        got.setdefault(r.rule_id, set()).add((r.page_id, r.pos_start, r.pos_end, r.evidence))
    for rule in rules:
        flags = sum({"i": re.I, "s": re.S, "m": re.M}[f] for f in rule.flags)
        want = {(i, m.start(), m.end(), m.group(0)) for i, text in enumerate(every) for m in re.finditer(rule.pattern, text, flags)}
        assert got.get(rule.key, set()) == want, (rule.pattern, rule.flags, linear(rule.pattern, rule.flags))


def test_what_a_pattern_requires():
    from pagescan.operators.custom import linear, required
    assert required(r"foo\s+(?:barbar|bazbaz)x?") == ("rbar", "zbaz") and required("ab|c") == ("ab", "c") and required("a*|b") == ()
    assert required("(?i)EVIL-[a-z]+") == ("evil-",) and required("éa") == ("a",) and required("") == ()
    assert linear("a+b") == "yes" and linear(r"a\b", "") == "ascii" and linear("a(?=b)") == linear(r"(a)\1") == linear("a*") == "no"


def test_a_rule_without_end_is_stopped(pages, monkeypatch):
    import time
    from pagescan.operators import custom
    monkeypatch.setattr(custom, "TIME_LIMIT", 1.0)
    rules = custom_rules([{"rule_id": "endless", "pattern": r"(?=(x+x+)+y)x"}, {"rule_id": "fine", "pattern": "xx"}])
    frame, begin = pages("x" * 40, "xxy"), time.perf_counter()
    assert {(r.page_id, r.rule_id) for r in custom_findings(frame, rules).collect()} == {(0, "fine"), (1, "endless"), (1, "fine")}
    assert [r.message for r in scan_errors(frame, rules).collect()] == ["endless: TimeoutError: more than 1 seconds"]
    assert time.perf_counter() - begin < 30


def test_a_thousand_rules_cost_their_hits(pages):
    import time
    frame = pages(*["some words r7z of a page " * 400] * 60)

    def seconds(n):
        rules = custom_rules([{"rule_id": f"r{i}", "pattern": rf"r{i}z\s+of" if i % 2 else rf"r{i}z(?= of)"} for i in range(n)])
        begin = time.perf_counter()
        assert custom_findings(frame, rules).count() == 60 * 400
        return time.perf_counter() - begin
    seconds(10)
    few, many = seconds(10), seconds(1000)
    assert many < 3 * few + 3, (few, many)


def test_user_rules(spark, pages, tmp_path):
    path = tmp_path / "rules.yaml"
    path.write_text("""rules:
  - {rule_id: "a:1", pattern: 'EVIL-[a-z]+', flags: "iq", severity: 99, description: d}
  - {rule_id: "a:2", pattern: '(', severity: 1}
  - {rule_id: "a:3", pattern: 'b*', severity: x}
  - {pattern: 'x'}
  - {rule_id: "a:4", pattern: 'b*'}
  - {rule_id: "a:5", pattern: '[^\\W\\d]z'}
""", "utf-8")
    rules = load_custom_rules(str(path))
    assert [r.key for r in rules] == ["a:1", "a:4", "a:5"]
    found = {(r.rule_id, r.evidence, r.pos_start, r.severity, r.category)
             for r in custom_findings(pages("bb evil-x éz 1z"), rules).collect()}
    assert ("a:1", "evil-x", 3, 10, "suspicious_pattern") in found and ("a:4", "bb", 0, 5, "suspicious_pattern") in found
    assert [f[1:3] for f in found if f[0] == "a:5"] == [("éz", 10)]
    assert load_custom_rules(str(tmp_path / "no.yaml")) == [] and custom_findings(pages("x"), []).count() == 0
    assert custom_rules([{"rule_id": "r", "pattern": "x"}])[0].metadata == {"description": "", "rule_file": "custom"}


def test_a_broken_detector_input_gives_an_error_row_not_a_failure(pages, monkeypatch):
    rows = scan(pages("http://q.bid:99999/e https://ok.xyz/")).where("rule_id = 'html:suspicious_url'").collect()
    assert {r.evidence for r in rows} == {"http://q.bid:99999/e", "https://ok.xyz/"}


class Fussy:
    """A detector that fails on some pages."""

    def detect(self, content, location):
        for at, word in enumerate(content.split()):
            if word == "fail":
                raise ValueError("no such page")
            yield {"rule_id": "own:word", "severity": 99, "evidence": word, "pos_start": at, "metadata": {"n": at}, "reasons": ["r"], "category": None}


def test_page_detectors_fail_alone(spark, pages):
    from pagescan.operators.detectors import page_detector
    from pagescan.plans.scan import errors_of, findings_of
    class Other:
        def detect(self, content, location):
            yield {"rule_id": "own:any", "evidence": str(location)}
            yield {}["rule_id"] if content == "" else {"rule_id": "own:second"}

    frame = pages("a b", "x fail y", "", ("https://l/", None), (None, "c"))
    rows = scan(frame, "fast", extra=[page_detector(Fussy(), Other())], errors=True)
    found = sorted((r.page_id, r.rule_id, r.evidence) for r in findings_of(rows).collect())
    assert found == [(0, "own:any", "https://www.site.com/page"), (0, "own:second", ""), (0, "own:word", "a"), (0, "own:word", "b"),
                     (1, "own:any", "https://www.site.com/page"), (1, "own:second", ""), (4, "own:any", "None"), (4, "own:second", ""), (4, "own:word", "c")]
    assert sorted((r.location, r.stage, r.message) for r in errors_of(rows).collect()) == sorted([
        ("https://www.site.com/page", "detector", "Fussy: ValueError: no such page"), ("https://www.site.com/page", "detector", "Other: KeyError: 'rule_id'"),
        ("https://l/", "detector", "Other: KeyError: 'rule_id'")])
    assert not [r for r in scan(frame, "fast", extra=[page_detector(Fussy())]).collect() if r.rule_id.startswith("#")]
    row = next(r for r in findings_of(rows).collect() if r.evidence == "b")
    assert (row.severity, row.category, row.pos_start, row.metadata, row.reasons) == (10, "suspicious_pattern", 1, {"n": "1"}, ["r"])


def test_pages_that_are_no_utf8(spark):
    rows = [(1, bytearray(b"<p style='display:none'>\xff\xfe eval(1) </p>")), (2, bytearray(b"\x80")), (3, bytearray("é display:none".encode()))]
    frame = spark.createDataFrame(rows, "page_id LONG, b BINARY").selectExpr("page_id", "CAST(X'FF' AS STRING) AS location", "CAST(b AS STRING) AS content")
    found = {(r.page_id, r.rule_id) for r in scan(frame, rules=custom_rules([{"rule_id": "own", "pattern": "\ufffd(?= eval)"}])).collect()}
    assert {(1, "hiding:display_none"), (1, "html:dom:styled_hidden"), (1, "own"), (3, "hiding:display_none")} <= found
    assert elements(frame).where("tag = 'p'").first().text == "\ufffd\ufffd eval(1) " and scan_errors(frame).count() == 0
    assert extract_urls(frame).count() == 0


def test_a_page_that_breaks_a_rule_loses_that_rule_only(pages, monkeypatch):
    from pagescan.functions.linear import _each
    import pyarrow as pa
    def of(texts):
        if "bad" in texts.to_pylist():
            raise RuntimeError("x")
        return [t.upper() for t in texts.to_pylist()]
    assert _each(pa.array(["a", "bad", "c"]), of, "rule") == [("A", None), (None, "rule: RuntimeError: x"), ("C", None)]


def test_findings_schema(pages):
    assert scan(pages("x"), "fast").schema.simpleString() == pages("x").sparkSession.createDataFrame(
        [], FINDINGS).schema.simpleString()
