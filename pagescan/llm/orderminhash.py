"""Document fingerprints by Order MinHash: likeness that follows the edit distance, not only the content.

A text's k-mers (``K`` characters) are numbered by occurrence, so a repeated k-mer is as many elements.  Each of ``SKETCHES``
orders of the elements gives the ``TUPLE`` least of them; these are put back in the order of the text and hashed together.
Two texts agree in a sketch if they share the least elements and have them in the same order, which moving a
passage breaks and a plain MinHash does not see.

The orders are turns of one hash circle: order i begins at i / SKETCHES of it.  All least elements so come from one
hash of each element; only elements close behind a beginning are sorted.

Likeness to an edited text needs the next document.  Documents are dealt to ranges of (doc_id, text) by bounds from
a sample, texts once; the first document of each range is also given to the range before, so that every task holds
the neighbours of its documents and no task sees more than its range.
"""

import bisect
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagescan.llm.common import valid_text

#: Characters of a k-mer (a power of two), elements of a sketch, sketches of a fingerprint (a power of two).
K, TUPLE, SKETCHES = 8, 2, 64
#: Bytes of text that a range is meant to hold, and sampled rows for each range.
RANGE_BYTES, SAMPLES = 128 << 20, 20
#: Equal rows from which results are dealt out again before they are repeated.
_MANY = 10_000
_BASE, _FAR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(64 - SKETCHES.bit_length() + 1)
_BEGIN = np.arange(SKETCHES, dtype=np.uint64) << _SHIFT


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def kmers(text: str) -> np.ndarray:
    """Hashes of the k-mers by position; of a shorter text the whole is the only one, of an empty text there is none."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    if len(code) < K:
        whole = np.zeros(min(len(code), 1), np.uint64)
        for c in code:
            whole = whole * _BASE + c
        return _stir(whole + np.uint64(len(code)))
    width, power = 1, int(_BASE)
    while width < K:
        code = code[:-width] * np.uint64(power) + code[width:]
        width, power = 2 * width, power * power % (1 << 64)
    return _stir(code)


def elements(hashes: np.ndarray) -> np.ndarray:
    """Hash of each k-mer with the number of its occurrence, counted from 0 in the order of the text."""
    n = len(hashes)
    bits = np.uint64(max(n - 1, 1).bit_length())
    key = ((hashes >> bits) << bits) | np.arange(n, dtype=np.uint64)
    key.sort()
    same = (key[1:] >> bits) == (key[:-1] >> bits)
    again = np.flatnonzero(same) + 1
    if not len(again):
        return _stir(hashes)
    # Runs of equal k-mers: the place in the run is the number of the occurrence.
    first = np.concatenate([[True], again[1:] != again[:-1] + 1])
    place = np.arange(len(again)) - np.maximum.accumulate(np.where(first, np.arange(len(again)), 0)) + 1
    number = np.zeros(n, np.uint64)
    number[(key[again] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] = place.astype(np.uint64)
    return _stir(hashes + number * _FAR)


def fingerprint(text: str) -> np.ndarray:
    """The sketches of a text as 16-bit numbers; all zero for an empty text."""
    hashes = kmers(text)
    n = len(hashes)
    if not n:
        return np.zeros(SKETCHES, np.uint16)
    marks = elements(hashes)
    near = None
    if n > 32 * SKETCHES:
        # About 24 elements close behind each beginning; if that leaves one with too few, all are sorted.
        rest = marks & ((np.uint64(1) << _SHIFT) - np.uint64(1))
        near = np.flatnonzero(rest < np.uint64((1 << int(_SHIFT)) * 24 * SKETCHES // n))
        if np.bincount((marks[near] >> _SHIFT).astype(np.int64), minlength=SKETCHES).min() < TUPLE:
            near = None
    near = np.arange(n) if near is None else near
    near = near[np.argsort(marks[near], kind="stable")]
    start = np.searchsorted(marks[near], _BEGIN)
    least = near[(start[:, None] + np.arange(min(TUPLE, n))) % len(near)]
    least.sort(axis=1)
    mixed = np.zeros(SKETCHES, np.uint64)
    for column in least.T:
        mixed = _stir(mixed * _BASE + hashes[column])
    return (mixed >> np.uint64(48)).astype(np.uint16)


def written(sketches: np.ndarray) -> str:
    return sketches.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the sketches that agree."""
    return float((a == b).mean())


def fingerprints(docs: DataFrame, keep=("doc_id",)) -> DataFrame:
    """``keep, n_chars, fingerprint`` for each row of ``docs(text)``: four hexadecimal digits for each sketch.

    NULL texts are empty; an empty text has all zeros; a text shorter than a k-mer is its own.  Equal texts have equal
    fingerprints.  Bytes that are no UTF-8 count as U+FFFD.  Other columns are not read.
    """
    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                                   pa.array([written(fingerprint(t)) for t in texts], pa.string())],
                                  schema=pa.schema([batch.schema.field(0), ("n_chars", pa.int64()), ("fingerprint", pa.string())]))

    rows = docs.select(F.struct(F.lit(0).alias("_"), *keep).alias("_keep"), valid_text().alias("text"))
    out = rows.mapInArrow(run, T.StructType([rows.schema["_keep"], T.StructField("n_chars", T.LongType()), T.StructField(
        "fingerprint", T.StringType())]))
    return out.select(*[F.col("_keep")[c].alias(c) for c in keep], "n_chars", "fingerprint")


def _ranges(keys: DataFrame) -> tuple[list[tuple], int]:
    """(bounds of (none, back, mark), number of ranges): about equal bytes, from a sample; results do not depend on them."""
    rows, size = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    number = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES + 1)
    share = min(1.0, number * SAMPLES / max(rows, 1))
    found = sorted(((r.none, r.back, r.mark), r.size + 64) for r in keys.sample(share, seed=13).collect())
    total, before, bounds = sum(s for _, s in found), 0, []
    for key, s in found:
        if before * number >= (len(bounds) + 1) * total and (not bounds or bounds[-1] < key):
            bounds.append(key)
        before += s
    return bounds, number


def _place(bounds: list[tuple]):
    @F.pandas_udf("int")
    def place(none: pd.Series, back: pd.Series, mark: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(bounds, key) for key in zip(none.tolist(), back.tolist(), mark.tolist())], dtype="int32")

    return place("none", "back", "mark")


def _merged(bounds: list[tuple]):
    """Rows with ``times`` and ``range``; equal ones of a batch become one."""
    def run(batches):
        for batch in batches:
            none, back, mark, texts = (batch.column(batch.schema.get_field_index(n)) for n in ("none", "back", "mark", "text"))
            keys = list(zip(none.to_pylist(), back.to_pylist(), mark.to_pylist()))
            times, rows = [1] * len(keys), range(len(keys))
            if len(set(keys)) < len(keys):
                first, times = {}, [0] * len(keys)
                for i, key in enumerate(zip(keys, texts.to_pylist())):
                    times[first.setdefault(key, i)] += 1
                rows = sorted(first.values())
            yield pa.RecordBatch.from_arrays(
                [*batch.take(pa.array(rows, pa.int64())).columns, pa.array([times[i] for i in rows], pa.int64()),
                 pa.array([bisect.bisect_right(bounds, keys[i]) for i in rows], pa.int32())],
                names=[*batch.schema.names, "times", "range"])

    return run


def _compared(batches):
    """Results for the rows of a range in order; its last row is the first of the next range, which gives no result."""
    now, out = None, []

    def result(this, other, times):
        doc_id, text, own = this
        half = len(text) // 2
        edited = text[:len(text) - half] + other[1][:half]
        of_edited = fingerprint(edited)
        return (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(own), written(of_edited),
                likeness(own, of_edited), likeness(own, other[2]), times)

    def batch_of(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_RESULT)

    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "text", "times", "guest")]
        for doc_id, text, times, guest in zip(*columns):
            text = text.as_py()
            row = (doc_id.as_py(), text, fingerprint(text))
            if now is not None:
                if now[1] > 1:
                    out.append(result(now[0], now[0], now[1] - 1))
                out.append(result(now[0], row, 1))
            now = None if guest.as_py() else (row, times.as_py())
            if len(out) >= 1000:
                yield batch_of(out)
                out = []
    if now is not None:
        raise RuntimeError("a range without the first document of the next one")
    if out:
        yield batch_of(out)


_RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "times"]


def edited_likeness(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for each row of ``docs(doc_id, text)``.

    The edited text is the text with its last half exchanged for as much of the beginning of the next document, in
    falling order of doc_id, NULL last; rows of one id follow each other by the hash of their texts, equal rows being next to each other;
    after the last comes the first, which for a single row is itself.  near_edited and near_next are the shares of equal sketches with
    the edited text's and the next document's fingerprint.  NULL texts are empty, and two empty texts are alike.  Bytes that are
    no UTF-8 count as U+FFFD.  An empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(valid_text(), F.lit("")).alias("text")).select(
        "doc_id", "text", F.col("doc_id").isNull().alias("none"),
        # Backwards without overflow.
        F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long")).alias("back"), F.xxhash64("text").alias("mark"))
    keys = rows.select("none", "back", "mark", F.octet_length("text").cast("long").alias("size"))
    bounds, number = _ranges(keys)
    heads = keys.select("none", "back", "mark", _place(bounds).alias("range")).groupBy("range").agg(
        F.min(F.struct("none", "back", "mark")).alias("head")).collect()
    heads.sort(key=lambda r: r.range)
    guests = spark.createDataFrame(
        [(*r["head"], heads[i - 1].range) for i, r in enumerate(heads)], "none BOOLEAN, back LONG, mark LONG, range INT")
    most = keys.groupBy("none", "back", "mark").count().agg(F.max("count")).first()[0] or 0
    at_home = rows.mapInArrow(_merged(bounds), T.StructType(
        [*rows.schema.fields, T.StructField("times", T.LongType()), T.StructField("range", T.IntegerType())])).withColumn("guest", F.lit(False))
    # One text for each range, so a broadcast of as many keys.
    visiting = rows.join(F.broadcast(guests), ["none", "back", "mark"]).dropDuplicates(["range"]).select(
        *rows.columns, F.lit(1).cast("long").alias("times"), "range", F.lit(True).alias("guest"))
    sorted_ = at_home.unionByName(visiting).repartitionById(number, F.col("range")).sortWithinPartitions(
        "guest", "none", "back", "mark")
    found = sorted_.select("doc_id", "text", "times", "guest").mapInArrow(
        _compared, "doc_id LONG, n_chars LONG, edited_sha256 STRING, fingerprint STRING, edited_fingerprint STRING, "
                   "near_edited DOUBLE, near_next DOUBLE, times LONG")
    if most > _MANY:
        # Equal rows were one on the way; as results they are dealt out in parts.
        parts = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {_MANY}"))).alias("part")
        found = found.select("*", parts).withColumn(
            "times", F.least(F.lit(_MANY).cast("long"), F.expr(f"times - part * {_MANY}"))).repartition(number)
    return found.select(*_RESULT[:-1], F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("_nth")).drop("_nth")
