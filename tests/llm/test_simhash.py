"""Fingerprints, links and components against brute force."""

import itertools
import re

import xxhash
from pyspark.sql import functions as F

from pagescan.llm import simhash
from pagescan.llm.common import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_fingerprint(text, n=3):
    found = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(found[i:i + n]) for i in range(len(found) - n + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=2):
    """Least id reachable, by growing sets until nothing joins."""
    groups = [{i} for i in range(len(prints))]
    for (i, a), (j, b) in itertools.combinations(enumerate(prints), 2):
        if (a ^ b).bit_count() <= radius and groups[i] is not groups[j]:
            both = groups[i] | groups[j]
            for k in both:
                groups[k] = both
    return [min(g) for g in groups]


def test_fingerprints_of_whole_texts():
    texts = ["", None, " \t\n", "One", "one two", "A b c D e f g h", "É é É", "a\x0bb\x0cc d\x1ce", "x y z " * 50]
    for text in texts:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(f"w{i * i % 1013}" for i in range(3000)) + "  tail\nof words"
    whole = plain_fingerprint(text)
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(simhash, "_CHUNK", size)
        assert simhash.fingerprint(text) == whole


def test_spark_hash_is_the_same(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("a b é")).alias("h")).first()
    assert row.h & (2**64 - 1) == xxhash.xxh64_intdigest("a b é".encode(), 42)


def test_tree_finds_all_within_the_radius(rng):
    values = list({rng.getrandbits(10) << 40 | rng.getrandbits(3) for _ in range(300)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:50]:
        for radius in (0, 1, 2, 5):
            assert sorted(tree.within(v, radius)) == sorted(w for w in values if (v ^ w).bit_count() <= radius)


def test_components_of_chains_and_near_prints(spark, rng):
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = [b ^ sum(1 << rng.randrange(64) for _ in range(k)) for b in base for k in (0, 0, 1, 2, 3)]
    chain, now = [], rng.getrandbits(64)
    for _ in range(25):
        now ^= 1 << rng.randrange(64) ^ 0
        now ^= 1 << rng.randrange(64)
        chain.append(now)
    prints = [p & (2**64 - 1) for p in prints + chain]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp BIGINT")
    got = {r.node: r.root for r in components(simhash.links(frame, 2), "fp", "root").collect()}
    ours = {}
    for i, p in enumerate(signed):
        ours.setdefault(got.get(p, p), set()).add(i)
    theirs = {}
    for i, least in enumerate(plain_components(prints)):
        theirs.setdefault(least, set()).add(i)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_odd_rows(odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 12
    zero = [r for r in rows if r.fp == 0]
    assert {r.component_id for r in zero} == {1} and len(zero) == 4
    assert {r.component_id for r in rows if r.doc_id in (4, 8)} == {4}


def test_deduplicate_keeps_one_row_of_each_component(odd, docs):
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id, (r.text or "")[:5]) for r in kept.collect())
    assert ids == [(1, ""), (4, "word0"), (5, "Other"), (5, "Same "), (6, "xxxxx"), (7, "é 中 \U0001f600")]


def test_empty_table_and_clashing_names(docs, clashing):
    assert simhash.near_duplicates(clashing.limit(0)).count() == 0
    assert sorted(map(tuple, simhash.near_duplicates(clashing).select("doc_id", "component_id").collect())) == [(1, 1), (2, 1), (3, 3)]
    assert simhash.deduplicate(clashing).columns == clashing.columns and simhash.deduplicate(clashing).count() == 2
