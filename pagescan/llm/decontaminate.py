"""Benchmark items inside documents: MinHash containment search by size classes, then exact containment.

An item is contained if at least ``threshold`` of its distinct word shingles occur anywhere in
the document.  Items are partitioned by size: class u holds items of u/2 < n <= u shingles.  An
item's sketch is its k least shingle hashes with k = floor((1 - threshold) * u) + 1 (all n if
fewer): a document that contains the item can miss at most k - 1 of its shingles, so it holds
one of the sketch for certain.  Every shingle of every document is looked up among the sketch
hashes, and what is hit is verified on the words themselves.  An item of fewer words than a shingle is
one shingle of its own length.

Documents stream through one pass without a shuffle, so hot passages and copies cost nothing
extra.  The items travel as a broadcast of bounded size; a larger benchmark is searched in
blocks, each a pass over the documents that gives only those it hits.
"""

import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagescan.llm.common import kept, small, valid_text

#: Words of the items that one pass searches for; a word takes about 25 bytes in an executor's worker.
BLOCK_WORDS = 4_000_000
_CHUNK = 1 << 20
_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, for the bytes of a piece; made once per task."""
    up, down = np.full(_CHUNK + 1, _BASE, np.uint64), np.full(_CHUNK + 1, _BACK, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: bytes, tables):
    """Arrays of hashes of the words, a piece of a megabyte at a time; a word over several pieces is put together.

    A word is a run of ASCII letters and digits and of any characters beyond ASCII.
    """
    (up, down), data = tables, np.frombuffer(data, np.uint8)
    open_sum, open_length = 0, 0
    for start in range(0, len(data), _CHUNK):
        piece = data[start:start + _CHUNK]
        edge = np.diff(_WORD[piece].astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(
            (piece.astype(np.uint64) + np.uint64(1)) * up[:len(piece)], dtype=np.uint64)])
        found, length = (sums[end] - sums[begin]) * down[begin], (end - begin).astype(np.uint64)
        if open_length:
            if len(begin) and begin[0] == 0:
                found[0] = np.uint64((open_sum + int(found[0]) * pow(int(_BASE), open_length, 1 << 64)) % (1 << 64))
                length[0] += np.uint64(open_length)
            else:
                found = np.concatenate([np.array([open_sum], np.uint64), found])
                length = np.concatenate([np.array([open_length], np.uint64), length])
        open_sum, open_length = 0, 0
        if len(end) and end[-1] == len(piece) and start + _CHUNK < len(data):
            open_sum, open_length = int(found[-1]), int(length[-1])
            found, length = found[:-1], length[:-1]
        yield _stir(found + length)


def shingles(text: str | None, n: int, tables):
    """Arrays of hashes of the shingles of ``n`` lower-cased words, in order."""
    tail = np.zeros(0, np.uint64)
    for word in word_hashes((text or "").lower().encode(), tables):
        word = np.concatenate([tail, word])
        tail = word[max(0, len(word) - n + 1):]
        count = len(word) - n + 1
        if count > 0:
            mixed = np.zeros(count, np.uint64)
            for i in range(n):
                mixed = mixed * _BASE + word[i:i + count]
            yield _stir(mixed)


def word_sets(text: str | None, n: int = 5, wanted: set | None = None) -> set:
    """The distinct shingles as tuples of words; only those ``wanted``, if given, which then bound what is held."""
    found, last = set(), deque(maxlen=n)
    for m in _WORDS.finditer((text or "").lower().encode()):
        last.append(m.group())
        if len(last) == n and (wanted is None or tuple(last) in wanted):
            found.add(tuple(last))
    return found


def sketches(rows, threshold: float, n: int) -> list[dict]:
    """The items of one block, ready for look-ups, for each length of shingle that they have: ids, texts, shingle hashes,
    and the sketch of each size class."""
    tables, by_length = powers(), {}
    for item_id, text in rows:
        words = len(_WORDS.findall((text or "").lower().encode()))
        if words:
            by_length.setdefault(min(n, words), []).append((item_id, text))
    out = []
    for length, items in sorted(by_length.items()):
        hashes = [np.unique(np.concatenate([*shingles(text, length, tables)])) for _, text in items]
        sketch = []
        for h in hashes:
            size_class = 1 << (len(h) - 1).bit_length()
            sketch.append(np.sort(_stir(h ^ _BASE))[:int((1 - threshold) * size_class + 1e-9) + 1])
        values = np.concatenate(sketch)
        owners = np.repeat(np.arange(len(items), dtype=np.int32), [len(s) for s in sketch])
        order = np.argsort(values, kind="stable")
        seen = np.zeros(1 << 20, bool)
        seen[values >> np.uint64(44)] = True
        out.append({"ids": [i for i, _ in items], "texts": [t for _, t in items], "hashes": hashes, "sketch": values[order],
                    "owners": owners[order], "seen": seen, "threshold": threshold, "n": length})
    return out


def inside(block: list[dict], text: str | None, tables) -> list[tuple]:
    """(item id, containment) of the items that the text contains."""
    out = []
    for items in block:
        pieces = [*shingles(text, items["n"], tables)]
        if not pieces:
            continue
        own = np.concatenate(pieces)
        marks = _stir(own ^ _BASE)
        marks = np.unique(marks[items["seen"][marks >> np.uint64(44)]])
        left, right = (np.searchsorted(items["sketch"], marks, side) for side in ("left", "right"))
        hit = {int(i) for a, b in zip(left, right) for i in items["owners"][a:b]}
        if not hit:
            continue
        own = np.unique(own)
        # Hashes first: they can only show more than there is.
        likely = [i for i in sorted(hit) if np.isin(items["hashes"][i], own, assume_unique=True).sum()
                  >= items["threshold"] * len(items["hashes"][i]) - 1e-9]
        sets = {i: word_sets(items["texts"][i], items["n"]) for i in likely}
        words = word_sets(text, items["n"], set().union(*sets.values())) if likely else set()
        out += [(items["ids"][i], len(exact & words) / len(exact)) for i, exact in sets.items()
                if len(exact & words) >= items["threshold"] * len(exact) - 1e-9]
    return out


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The items in blocks of at most ``BLOCK_WORDS`` characters' worth of words, or single items beyond."""
    items = benchmark.select(F.col("item_id").cast("long"), valid_text().alias("text")).where(
        "text IS NOT NULL").distinct()
    weight, rows = items.agg(F.coalesce(F.sum(F.length("text") / 2), F.lit(0)), F.count("*")).first()
    number = int(weight // BLOCK_WORDS) + 1
    block = lambda n: F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    while number < rows:
        top = items.groupBy(block(number).alias("b")).agg(F.sum(F.length("text") / 2).alias("w"),
                                                          F.count("*").alias("n")).where("n > 1").agg(F.max("w")).first()[0]
        if (top or 0) <= BLOCK_WORDS:
            break
        number *= 2
    return [items.where(block(number) == i) for i in range(number)]


def search(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, shingle: int = 5, keep=()) -> DataFrame:
    """``doc_id``, the columns in ``keep``, and ``item_ids``, ``containments``: a row per row of ``docs``.

    The arrays list the benchmark items (``item_id``, ``text``) of which at least ``threshold`` of the
    distinct shingles of ``shingle`` words occur in the document, by item id, NULL ids last; both are empty
    where there is none.  NULL and empty texts contain nothing, and items without a word are in nothing.  An item with fewer
    words than a shingle is one shingle of that length.  Equal items (id and text) count once; an id with two texts can be
    listed twice.  Bytes that are no UTF-8 count as U+FFFD.  ``keep`` must not name results; other columns are not read.
    """
    columns = ["doc_id", *[c for c in keep if c != "doc_id"]]
    rows = docs.select(F.struct(*columns).alias("_keep"), valid_text().alias("_text"))
    found, blocks = None, _blocks(benchmark)
    for number, block in enumerate(blocks):
        items = docs.sparkSession.sparkContext.broadcast(sketches([tuple(r) for r in block.collect()], threshold, shingle))
        if len(blocks) == 1:
            found = rows.mapInArrow(_finder(items), _with_items(rows.schema["_keep"]))
            return found.select(*[F.col("_keep")[c].alias(c) for c in columns], "item_ids", "containments")
        hits = rows.select(F.xxhash64("_text").alias("_mark"), "_text").mapInArrow(
            _finder(items), _with_items(T.StructField("_mark", T.LongType()))).where("size(item_ids) > 0")
        # Documents of one hash have one text, and give equal rows.
        hits = kept(hits.dropDuplicates(["_mark"]))
        found = hits if found is None else found.unionByName(hits)
    pairs = found.select("_mark", F.explode(F.arrays_zip("item_ids", "containments")).alias("_pair"))
    lists = kept(pairs.groupBy("_mark").agg(F.array_sort(F.collect_list(F.struct(
        F.col("_pair.item_ids").isNull().alias("none"), F.col("_pair.item_ids").alias("id"), F.col("_pair.containments").alias("c")))).alias("_all")))
    joined = rows.select("_keep", F.xxhash64("_text").alias("_of")).join(
        small(lists, "1 + size(_all)"), F.col("_of") == F.col("_mark"), "left")
    return joined.select(*[F.col("_keep")[c].alias(c) for c in columns], *[
        F.coalesce(F.col(f"_all.{field}").cast(kind), F.array().cast(kind)).alias(name)
        for name, field, kind in (("item_ids", "id", "array<bigint>"), ("containments", "c", "array<double>"))])


def _with_items(first: T.StructField) -> T.StructType:
    return T.StructType([first, T.StructField("item_ids", T.ArrayType(T.LongType())),
                         T.StructField("containments", T.ArrayType(T.DoubleType()))])


def _finder(items):
    def run(batches):
        tables = powers()
        for batch in batches:
            ids, shares = [], []
            for text in batch.column(1):
                found = sorted(inside(items.value, text.as_py(), tables), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
                ids.append([i for i, _ in found])
                shares.append([s for _, s in found])
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int64())), pa.array(shares, pa.list_(pa.float64()))],
                                  names=[batch.schema.names[0], "item_ids", "containments"])

    return run
