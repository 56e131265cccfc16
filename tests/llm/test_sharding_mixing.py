"""Shards and mixes: laws, totals, odd rows."""

import zlib
from collections import Counter

import numpy as np
import pytest

from pagescan.llm import mixing, sharding
from pagescan.llm.queries import QUERIES
from tests.conftest import SF


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_loop_and_moves_only_to_the_new_shard(rng):
    keys = [rng.getrandbits(64) for _ in range(3000)]
    for n in (1, 2, 24, 25, 1000):
        assert sharding.jump(np.array(keys, np.uint64), n).tolist() == [plain_jump(k, n) for k in keys]
    before, after = (sharding.jump(np.array(keys, np.uint64), n) for n in (24, 25))
    moved = before != after
    assert set(after[moved]) == {24} and 0.02 < moved.mean() < 0.06


def test_query_is_the_plain_loop(spark):
    """The registered query against jump hashing row by row and numbering by hand."""
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    marks = {r.doc_id: r.m for r in spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "xxhash64('shard', CAST(doc_id AS STRING)) AS m").collect()}
    got = {r.doc_id: r for r in QUERIES["op10_sharding"](spark, SF).collect()}
    assert set(got) == {r["doc_id"] for r in rows} and len(got) == len(rows)
    for r in rows:
        key, text, g = marks[r["doc_id"]] % 2**64, (r["text"] or "").encode(), got[r["doc_id"]]
        assert (g.law, g.shard, g.grown_shard) == ("key", plain_jump(key, 24), plain_jump(key, 25))
        assert (g["size"], g.text_crc32) == (len(text) + 8, zlib.crc32(text))
    for shard in range(24):
        slots = sorted(g.slot for g in got.values() if g.shard == shard)
        assert slots == list(range(len(slots)))


def test_shards_of_odd_rows(odd):
    rows = sharding.shard(odd, 5).collect()
    assert len(rows) == 12
    for shard in range(5):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == texts
    assert len({r.shard for r in rows if r.doc_id == 5}) == 1 and {r.law for r in rows} == {"key"}
    again = sharding.shard(odd.repartition(7), 5).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_shard_keeps_columns_and_takes_empty_and_clashing_tables(odd, clashing):
    assert sharding.shard(odd.limit(0)).count() == 0
    wide = sharding.shard(odd, 5, keep=odd.columns)
    assert wide.columns == [*odd.columns, "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert wide.select("doc_id", "text").exceptAll(odd.select("doc_id", "text")).count() == 0 and wide.count() == 12
    assert sharding.shard(clashing).count() == 3


def test_write_shards(odd, tmp_path, spark):
    sharding.write_shards(odd, str(tmp_path / "out"), 3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12


def water(sizes, weights, most):
    """Shares by hand: give by weight, cap, share the excess again."""
    total, target, free = sum(sizes.values()), dict.fromkeys(sizes, 0.0), set(sizes)
    left = float(total)
    while left > 1e-9 and free:
        w = sum(weights[s] for s in free)
        gift, left = {s: left * weights[s] / w for s in free}, 0.0
        for s, g in gift.items():
            target[s] += g
            if target[s] > most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 900, "c": 30, "d": 5, None: 700}, {"x": 50}, {"x": 0, "y": 10}, {"a": 1, "b": 1, "c": 1, "d": 10_000}])
def test_targets_are_what_sharing_again_and_again_gives(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source STRING, source_size BIGINT")
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    assert got == pytest.approx(want)


def test_mix_comes_near_its_targets_and_grows_nested(docs, rng):
    rows = [(i, "w " * rng.choice([1, 5, 40, 3000]), "en", rng.choice(["a", "a", "a", "b", None])) for i in range(400)]
    frame = docs(*rows)
    got = mixing.mix(frame, keep=["source"]).collect()
    assert len(got) == 400 and all(r["size"] == len(rows[r.doc_id][1].split()) for r in got)
    for source in ("a", "b", None):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2
        assert {r.source_size for r in own} == {sum(r["size"] for r in own)}
    assert all(0 <= r.taken <= 3 * r["size"] and abs(r.copies * r["size"] - r.taken) <= r["size"] / 2 + 1 for r in got)
    assert sorted(map(str, mixing.mix(frame.repartition(5), keep=["source"]).collect())) == sorted(map(str, got))
    # A larger budget takes all that a smaller one takes.
    smaller = {r.doc_id: r.taken for r in mixing.mix(frame, weights=(1, 1, 8)).collect()}
    larger = {r.doc_id: r.taken for r in mixing.mix(frame, weights=(2, 1, 8)).collect()}
    assert all(larger[r[0]] >= smaller[r[0]] for r in rows if r[3] == "a")


def test_mix_with_one_id_and_odd_rows(docs, odd, clashing):
    same = docs(*[(1, "a b c d", "en", s) for s in ("a", "a", "a", "b", "b")])
    got = mixing.mix(same, keep=["source"]).collect()
    for source in "ab":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= len(own)
    assert mixing.mix(odd).count() == 12 and mixing.mix(odd.limit(0)).count() == 0
    assert mixing.mix(clashing).count() == 3


@pytest.mark.parametrize("spread", [False, True])
def test_null_and_equal_ids_come_near_the_target(spark, docs, monkeypatch, spread):
    if spread:
        monkeypatch.setattr(mixing, "_PART", 70)
    rows = [(None, "one two three", "en", "a")] * 2000 + [(None, f"one two {i}", "en", "a") for i in range(2000)]
    rows += [(7, "same here", "en", "b")] * 1500 + [(7, "", "en", "b")] * 5
    got = mixing.mix(docs(*rows), keep=["source", "text"]).collect()
    assert len(got) == len(rows)
    for source in "ab":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
        assert all(0 <= r.taken <= 3 * r["size"] for r in own)
    equal = Counter(r.taken for r in got if r.text == "same here")
    assert len(equal) <= 3
    assert sorted(map(str, mixing.mix(docs(*rows).repartition(5), keep=["source", "text"]).collect())) == sorted(map(str, got))
