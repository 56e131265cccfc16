"""Near-duplicate documents by SimHash fingerprints and BK-trees.

A fingerprint has 64 bits; documents link where fingerprints differ in few bits, and a
component is everything reachable over links.  Equal fingerprints are one node from the
start, so copies cost nothing.  Fingerprints are dealt to shards by the bits they would
have to share: 64 bits in eight blocks, and a pair within two bits agrees outside at most
two of them.  A shard is thus one choice of six blocks with one value; it holds at most
2**16 fingerprints, whatever the data.  In a shard's BK-tree the children of a node are
keyed by their integer distance to it; a search follows only keys within the radius.
A shard reports each fingerprint with its root in the shard, not the pairs.
"""

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescan.llm.common import components, kept

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_CHUNK = 1 << 20
_BLOCKS, _BLOCK_BITS = 8, 8


def fingerprint(text: str | bytes | None, shingle: int = 3) -> int:
    """SimHash of the word shingles; zero where there is no word.

    The text is worked through in pieces of a megabyte, so a very long one needs little memory.
    """
    data = (text.encode() if isinstance(text, str) else text or b"").translate(_LOWER)
    ones, total, tail, start = np.zeros(64, np.int64), 0, [], 0
    while start < len(data):
        cut = _SPACE.search(data, min(start + _CHUNK, len(data)))
        stop = cut.start() if cut else len(data)
        found = tail + data[start:stop].split()
        start = stop
        if len(found) >= shingle:
            ones, total = ones + _ones(map(b" ".join, zip(*(found[i:] for i in range(shingle))))), \
                total + len(found) - shingle + 1
            tail = found[len(found) - shingle + 1:]
        else:
            tail = found
    if not total:
        if not tail:
            return 0
        ones, total = _ones([b" ".join(tail)]), 1
    return int(np.packbits(2 * ones > total).view("<u8")[0])


def _ones(shingles) -> np.ndarray:
    """How often each bit is set in the hashes."""
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, 42) for s in shingles], "<u8")
    return np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3, keep=()) -> DataFrame:
    """``doc_id``, the columns in ``keep`` and ``fp``, the fingerprint as a signed long; a row per row, no shuffle."""
    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            prints = np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64)
            yield pa.record_batch([*batch.columns[:-1], pa.array(prints.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), *keep, F.col("text").cast("string").cast("binary").alias("_of"))
    return rows.mapInArrow(run, rows.drop("_of").schema.add("fp", "long"))


class BKTree:
    """Fingerprints by Hamming distance: a node is ``[value, children by distance to value]``."""

    def __init__(self):
        self.root = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while d := (node[0] ^ value).bit_count():
            child = node[1].get(d)
            if child is None:
                node[1][d] = [value, {}]
                return
            node = child

    def within(self, value: int, radius: int):
        """The values at most ``radius`` bits away; only edges within the radius are followed."""
        open_nodes = [self.root] if self.root else []
        while open_nodes:
            node, children = open_nodes.pop()
            d = (node ^ value).bit_count()
            if d <= radius:
                yield node
            for k in range(d - radius, d + radius + 1):
                if k in children:
                    open_nodes.append(children[k])


def shard_links(values, radius: int):
    """``(value, root)`` for values of one shard that are linked in it; root is the least of them."""
    tree, parent = BKTree(), {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for value in values:
        parent[value] = value
        for other in tree.within(value, radius):
            a, b = find(value), find(other)
            parent[max(a, b)] = min(a, b)
        tree.add(value)
    return [(v, r) for v in values if (r := find(v)) != v]


def _shards(radius: int) -> str:
    """SQL array of (shard number, mask of the bits that must agree), one per choice of free blocks."""
    rows = []
    for n, free in enumerate(itertools.combinations(range(_BLOCKS), radius)):
        mask = (1 << 64) - 1
        for block in free:
            mask &= ~(((1 << _BLOCK_BITS) - 1) << block * _BLOCK_BITS)
        mask = mask - (1 << 64) if mask >> 63 else mask
        rows.append(f"named_struct('no', {n}, 'mask', {mask}L)")
    return f"array({', '.join(rows)})"


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """``fp, root``: links between different fingerprints that join all within ``radius`` bits (0 to 2)."""
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2: shards of wider searches have no useful size bound")

    def run(batches):
        rest = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                table = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
                rest = table if rest is None else np.concatenate([rest, table], axis=1)
            if rest is None or not rest.shape[1]:
                continue
            new = np.flatnonzero((rest[:2, 1:] != rest[:2, :-1]).any(axis=0)) + 1
            bounds = np.concatenate([[0], new, [rest.shape[1]]])
            # The last shard may go on in the next batch.
            ends = bounds if batch is None else bounds[:-1]
            out = []
            for i in np.flatnonzero(np.diff(ends) > 1):
                out += shard_links([x & (2**64 - 1) for x in rest[2, ends[i]:ends[i + 1]].tolist()], radius)
            rest = rest[:, ends[-1]:]
            if out:
                pairs = np.array(out, np.uint64).view(np.int64)
                yield pa.record_batch([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["fp", "root"])

    dealt = (prints.select("fp").distinct()
             .select("fp", F.explode(F.expr(_shards(radius))).alias("shard"))
             .selectExpr("shard.no AS no", "fp & shard.mask AS bits", "fp")
             .repartition("no", "bits").sortWithinPartitions("no", "bits"))
    return dealt.mapInArrow(run, "fp BIGINT, root BIGINT").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, keep=()) -> DataFrame:
    """``doc_id``, the columns in ``keep``, ``fp, component_id``, a row for each row of ``docs(doc_id, text)``.

    component_id is the least doc_id reachable over links, the document itself included; NULL
    ids do not count, and a component of NULL ids only has NULL.  NULL, empty and blank texts
    have fingerprint zero, which links like any other.  Repeated rows stay repeated.  Texts are
    taken as bytes, so such as are no UTF-8 count as they are.  Other columns are not looked at.
    """
    return _classes(docs, shingle, radius, keep).drop("root")


def _classes(docs: DataFrame, shingle: int, radius: int, keep) -> DataFrame:
    """``near_duplicates`` with ``root``, the least fingerprint of the component."""
    prints = kept(fingerprints(docs, shingle, keep))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(prints, radius), "fp", "root")
    nodes = kept(least.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")))
    merged = kept(nodes.groupBy("root").agg(F.min("least").alias("component_id")))
    ids = kept(nodes.join(merged, "root").select("fp", "root", "component_id"))
    return prints.join(ids, "fp").select("doc_id", *keep, "fp", "root", "component_id")


def deduplicate(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row of each component, all columns: the row of least doc_id.

    Of rows that share that id the one with the least hash of its text stays, and of fully equal rows
    one; a NULL id stays only where a component has no other.  NULL, empty and blank texts are one
    component; an empty table stays empty; columns of any name go through untouched.
    """
    mark = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = _classes(docs.select("doc_id", "text", mark.alias("_mark")), shingle, radius, ["_mark"])
    first = kept(found.where("doc_id <=> component_id").groupBy("doc_id", "root").agg(
        F.min("_mark").alias("_mark")).select(F.col("doc_id").alias("_id"), "_mark"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), mark.alias("_of"))
    stay = rows.join(first, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_mark")), "left_semi")
    return stay.dropDuplicates(["_doc", "_of"]).select("_row.*")
