"""Order MinHash against sorting all elements for each sketch, and edited texts against plain Python."""

import hashlib

import numpy as np
import pytest

from pagescan.llm import orderminhash as O
from pagescan.llm.queries import QUERIES
from tests.conftest import SF

MASK = (1 << 64) - 1


def stir(x):
    x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD & MASK
    x = (x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53 & MASK
    return x ^ (x >> 33)


def plain_fingerprint(text):
    """The definition word by word: numbered k-mers, all sorted for each order, the least in text order, hashed."""
    base, seen, rows = int(O._BASE), {}, []
    windows = [text[i:i + O.K] for i in range(len(text) - O.K + 1)] or ([text] if text else [])
    for at, w in enumerate(windows):
        h = 0
        for c in w:
            h = (h * base + ord(c) + 1) & MASK
        h = stir(h if len(w) == O.K else (h + len(w)) & MASK)
        number = seen[w] = seen.get(w, -1) + 1
        rows.append((stir((h + number * int(O._FAR)) & MASK), at, h))
    out = []
    for i in range(O.SKETCHES):
        begin, mixed = i * (1 << 64) // O.SKETCHES, 0
        least = sorted(rows, key=lambda r: ((r[0] - begin) & MASK, r[1]))[:O.TUPLE]
        for _, _, h in sorted(least, key=lambda r: r[1]):
            mixed = stir((mixed * base + h) & MASK)
        out.append(mixed >> 48)
    return "".join(f"{s:04x}" for s in out)


def plain(rows):
    """Result tuples of (doc_id, text) rows, rows of one id by Spark's hash of the text given as third item."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))
    out = []
    for i, (doc_id, text, _) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, b, c = map(plain_fingerprint, (text, edited, after))
        same = lambda x, y: sum(x[k:k + 4] == y[k:k + 4] for k in range(0, len(x), 4)) / O.SKETCHES
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, same(a, b), same(a, c)))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r) for r in O.edited_likeness(frame).collect()), key=str)


def marked(frame):
    from pyspark.sql import functions as F
    return [tuple(r) for r in frame.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]


@pytest.mark.parametrize("text", ["", "a", "abcdefg", "abcdefgh", "abcdefghi", "aaaaaaaaaaaaaaaaaaaaaa", "ab" * 40, "é中\U0001f600" * 9, "\x00" * 20])
def test_fingerprint_of_short_texts(text):
    assert O.written(O.fingerprint(text)) == plain_fingerprint(text)


def test_fingerprint_of_long_and_repetitive_texts(rng):
    for size in (500, 2100, 6000):
        for letters in ("ab", "abcdefghijklmnop "):
            text = "".join(rng.choice(letters) for _ in range(size))
            assert O.written(O.fingerprint(text)) == plain_fingerprint(text)
    text = "x" * 5000 + "".join(rng.choice("abcdefgh") for _ in range(50))
    assert O.written(O.fingerprint(text)) == plain_fingerprint(text)


def test_likeness_follows_edits_and_order(rng):
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(4000))
    near = O.likeness(O.fingerprint(text), O.fingerprint(text[:2000] + "#" + text[2000:]))
    far = O.likeness(O.fingerprint(text), O.fingerprint("".join("#" + text[i:i + 20] for i in range(0, 4000, 20))))
    turned = O.likeness(O.fingerprint(text), O.fingerprint("".join(text[i:i + 40] for i in range(3960, -1, -40))))
    other = O.likeness(O.fingerprint(text), O.fingerprint("".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(4000))))
    assert near > 0.9 > far > other == 0
    # Most k-mers of the text put together backwards are the same, but most pairs stand the other way round.
    shared = len({text[i:i + 8] for i in range(3993)} & {t[i:i + 8] for t in ["".join(text[i:i + 40] for i in range(3960, -1, -40))] for i in range(3993)})
    assert shared > 0.8 * 3993 and turned < 0.25


def test_whole_table(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1500")
    assert got(frame) == plain(marked(frame))


def test_query(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {r.doc_id: r for r in QUERIES["op13_fingerprints"](spark, SF).collect()}
    order = sorted(rows, reverse=True)
    for i, d in enumerate(order):
        text, after = rows[d], rows[order[(i + 1) % len(order)]]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, b, c = map(O.fingerprint, (text, edited, after))
        r = found.pop(d)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (O.written(a), O.written(b))
        assert (r.near_edited, r.near_next) == (O.likeness(a, b), O.likeness(a, c))
    assert not found


def test_many_ranges(spark, docs, rng, monkeypatch):
    """Bounds anywhere, also between rows of one id, give the same rows; fewer ids than ranges too."""
    rows = [(rng.randrange(40) if rng.random() < 0.9 else None, "".join(rng.choice("ab cd") for _ in range(rng.randrange(60)))) for _ in range(150)]
    frame = docs(*rows)
    want = plain(marked(frame))
    monkeypatch.setattr(O, "RANGE_BYTES", 100)
    monkeypatch.setattr(O, "SAMPLES", 1000)
    assert got(frame) == want
    monkeypatch.setattr(O, "SAMPLES", 1)
    assert got(frame.repartition(7)) == want


def test_equal_rows_are_merged_and_spread(spark, docs, monkeypatch):
    rows = [(5, "the same text again and again")] * 700 + [(9, "above all"), (5, "another text"), (1, "below")]
    frame = docs(*rows)
    want = plain(marked(frame))
    assert got(frame) == want
    monkeypatch.setattr(O, "_MANY", 100)
    assert got(frame) == want


def test_odd_rows(odd, docs, clashing):
    small = odd.where("text IS NULL OR length(text) < 1000")
    assert got(small) == plain(marked(small))
    assert len(got(odd)) == odd.count()
    assert got(odd.limit(0)) == []
    one = docs((7, "only one document here"))
    assert got(one) == plain(marked(one))
    extreme = docs((2 ** 63 - 1, "highest"), (-(2 ** 63), "lowest"), (0, "zero"), (None, "none"))
    assert got(extreme) == plain(marked(extreme))
    named = clashing.selectExpr("*", "1 AS none", "1 AS back", "2 AS mark", "3 AS times", "4 AS guest", "5 AS range", "6 AS near_next")
    assert got(named) == plain(marked(named))


def test_plain_fingerprints(odd, clashing):
    found = O.fingerprints(odd).collect()
    assert len(found) == odd.count()
    assert {r.fingerprint for r in found if r.n_chars == 0} == {"0" * 256}
    kept = O.fingerprints(clashing, ["doc_id", "fp", "size"])
    assert kept.columns == ["doc_id", "fp", "size", "n_chars", "fingerprint"] and kept.count() == 3


def test_text_that_is_no_utf8(spark):
    frame = spark.createDataFrame([(1, bytearray(b"\xff\xfe abc"))], "doc_id LONG, b BINARY").selectExpr("doc_id", "CAST(b AS STRING) AS text")
    row = O.edited_likeness(frame).first()
    assert row.fingerprint == plain_fingerprint("�� abc") and row.n_chars == 6


def test_sketches_are_numbers_of_16_bits():
    assert O.fingerprint("some text that is long enough").dtype == np.uint16
