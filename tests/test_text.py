"""Match extraction and pattern translation against Python's own ``re``."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pagescan.functions.dialect import to_java
from pagescan.functions.text import fold, lit, matches

random.seed(3)
TEXTS = ["", "abc", "xxaxa a", "éaéa　😀a\na", "a" * 50, "ab" * 300 + "zz",
         "-".join("a" * random.randint(0, 3) for _ in range(400)), "q" * 60 + "a" + "q" * 60 + "aqa"]


@pytest.mark.parametrize("margin", [3, 50])
@pytest.mark.parametrize("pattern, flags, groups", [
    ("a", "", ()), ("(A)(b?)", "i", (1, 2)), (r"\w+", "", ()), (r"\s", "", ()), (r"\ba", "", ()), ("a.", "s", ())])
def test_matches_have_the_offsets_and_contexts_of_re(pages, pattern, flags, groups, margin):
    rows = pages(*TEXTS).select("content", F.expr(matches("content", pattern, flags, groups, margin)).alias("m"))
    compiled = re.compile(pattern, sum({"i": re.I, "s": re.S}[f] for f in flags))
    for text, found in rows.collect():
        expected = [(m.group(0), m.start(), m.end(), text[max(0, m.start() - margin):m.start()],
                     text[m.end():m.end() + margin], *[m.group(g) or "" for g in groups])
                    for m in compiled.finditer(text)]
        assert [tuple(s)[:5] + tuple(s[f"g{g}"] for g in groups) for s in found or []] == expected


PATTERNS = [(r"\beval\s*\(", ""), (r"\bon\w+", "i"), (r"^\d+$", "m"), (r"[\w-]+\.[^\s<]+", ""), (r"a.b", ""), (r"a.b", "s"),
            (r"x\b", ""), (r"\Bb", ""), (r"[[\]&&]", ""), (r"(?P<q>['\"]).*?(?P=q)", ""), (r"k", "i"), (r"s{,2}i", "i"),
            (r"{x}", ""), (r"\S+@", ""), (r"a[\s\S]b", ""), (r"é\b|中\b", "")]
SAMPLES = ["eval(1) 中eval (2) ​eval(3) _eval(4)", "onclick ONLOAD a-on1 İon", "12\n٣٤\n5a", "é-x.com/ü z",
           "a\rb a\nb a b ab", "x x1 xé x", "bb ab", "[]&x", "'a\"' \"b'\"", "KKk", "ssI ſi ı", "{x} x",
           "a@ 　b@", "abc1_é", "é中 é中1"]


def test_translated_patterns_match_what_re_matches(pages):
    columns = [F.expr(f"regexp_extract_all(content, {lit(to_java(p, f))}, 0)").alias(f"p{i}")
               for i, (p, f) in enumerate(PATTERNS)]
    for row in pages(*SAMPLES).select("content", *columns).collect():
        for i, (pattern, flags) in enumerate(PATTERNS):
            compiled = re.compile(pattern, sum({"i": re.I, "s": re.S, "m": re.M}[f] for f in flags))
            expected = [m.group(0) for m in compiled.finditer(row.content)]
            assert row[f"p{i}"] == expected, (pattern, flags, row.content)


def test_fold_keeps_length_and_covers_case_insensitive_letters(pages):
    text = "İıſK ΣςÀ K"
    folded = pages(text).select(F.expr(fold("content"))).first()[0]
    assert len(folded) == len(text) and folded.startswith("iisk σσà k")


def test_very_many_matches_in_one_page(pages):
    count, last = pages("xya " * 50_000).select(
        F.expr(f"size({matches('content', 'a')})"), F.expr(f"element_at({matches('content', 'a')}, -1).start")).first()
    assert (count, last) == (50_000, 4 * 49_999 + 2)
