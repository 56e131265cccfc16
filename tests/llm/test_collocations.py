"""Phrase mining against counting every phrase in plain Python."""

import re
from collections import Counter, defaultdict

import pytest

from pagescan.llm import collocations as C
from pagescan.llm.collocations import collocations

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=30, longest=4, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) tuples from (text, lang) rows."""
    count, words = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(ASCII)):
            found = [w for w in re.split("[ \t]+", piece) if w]
            words[lang] += len(found)
            for k in range(1, longest + 1):
                for i in range(len(found) - k + 1):
                    count[lang][tuple(found[i:i + k])] += 1
    out = []
    for lang, f in count.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        swallowed = set()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * a >= 80 * f[p[i:i + k]]:
                        swallowed.add(p[i:i + k])
        scored = []
        for p, a in candidates.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if p not in swallowed:
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


def got(docs, **options):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in collocations(docs, **options).collect())


def invented(rng, rows=60):
    """Texts of a few words with set phrases, pieces and capitals."""
    phrases = ["New York City", "at the end of the day", "in front of", "a a a a", "as well as", "x. y", "the the"]
    out = []
    for _ in range(rows):
        parts = []
        for _ in range(rng.randrange(80)):
            parts.append(rng.choice(phrases) if rng.random() < 0.3 else rng.choice("abcdefg") * rng.randrange(1, 3))
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "; ", " -- "]))
        out.append(("".join(parts), rng.choice(["en", "en", "en", "de", None, "und"])))
    return out


@pytest.mark.parametrize("block,chunk,groups,few", [(1 << 19, 1 << 20, 1 << 18, 10 ** 6), (50, 20, 7, 10 ** 6), (50, 20, 7, 3), (1, 1, 1, 0)])
def test_equals_plain_counting(spark, docs, rng, monkeypatch, block, chunk, groups, few):
    monkeypatch.setattr(C, "FEW", few)
    monkeypatch.setattr(C, "FEW_WORDS", few)
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "_CHUNK", chunk)
    monkeypatch.setattr(C, "_GROUPS", groups)
    rows = invented(rng)
    frame = spark.createDataFrame(rows, "text STRING, lang STRING").repartition(3)
    want = plain(rows, least=5)
    assert len(want) > 40 and got(frame, least=5) == want
    assert got(frame, least=5, longest=2) == plain(rows, 5, 2)
    assert got(frame, least=5, top=3) == plain(rows, 5, top=3)


def test_pieces_and_documents_are_not_joined(spark):
    rows = [("a b", "en")] * 5 + [("b. c", "en")] * 5 + [("c", "en"), ("d", "en")] * 5 + [("e\tf \t g", None)] * 5
    frame = spark.createDataFrame(rows, "text STRING, lang STRING").coalesce(1)
    assert got(frame, least=5) == plain(rows, least=5) == [
        ("en", 1, "a b", 5, 5, 10, 30, 666_666), ("und", 1, "e f g", 5, 5, 5, 15, 1_000_000)]


def test_odd_rows(odd, docs):
    rows = [(r.text, r.lang) for r in odd.collect()]
    assert got(odd, least=2) == plain(rows, least=2)
    assert collocations(odd.limit(0)).count() == 0
    strange = [(b, None) for b in ("\x0b\x0c\x1f \x85 \xa0 word ÄÖ äö",) * 3] + [("ÀB àb " * 40, "fr")]
    frame = docs(*[(i, *r) for i, r in enumerate(strange)])
    assert got(frame, least=3) == plain(strange, least=3)


def test_hot_phrase_and_a_million_words_in_one_piece(spark):
    rows = [("the end " * 400_000, "en"), ("the end. " * 1000, "de")]
    frame = spark.createDataFrame(rows, "text STRING, lang STRING")
    assert got(frame) == plain(rows)


def test_text_that_is_no_utf8(spark):
    frame = spark.createDataFrame([(bytearray(b"one \xff\xfe two " * 40),)], "b BINARY").selectExpr("CAST(b AS STRING) AS text", "'en' AS lang")
    text = frame.selectExpr("make_valid_utf8(text) AS t").first().t
    assert got(frame) == plain([(text, "en")])


def test_clashing_names(clashing):
    rows = [(r.text, r.lang) for r in clashing.collect()]
    named = clashing.selectExpr("*", "1 AS block", "1 AS local", "2 AS n", "3 AS id", "4 AS left", "5 AS f", "6 AS rank")
    assert got(named, least=4) == plain(rows, least=4) != []


def test_products_beyond_64_bits(spark):
    phrases = spark.createDataFrame([(0, "en", "a b", 9 * 10 ** 17, [10 ** 18, 9 * 10 ** 17], [8 * 10 ** 18, 9 * 10 ** 17])],
                                    "id LONG, lang STRING, phrase STRING, f LONG, prefixes ARRAY<LONG>, suffixes ARRAY<LONG>")
    row = C._scored(phrases, 2).first()
    assert row.score == 2_000_000 * 9 * 10 ** 17 // (9 * 10 ** 18)
