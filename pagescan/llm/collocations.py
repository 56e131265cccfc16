"""Phrases of words that belong together, by set-oriented mining (SETM) over relations of occurrences.

The first relation has a row for each word of the corpus, in order of piece and position; the relation of length k + 1 comes from
that of length k by a merge join with itself on the same piece and the adjacent position.  After each join occurrences are
counted by group, and only those of frequent groups go into the next one (a semi join with the frequent groups).

A relation is stored in blocks of half a million occurrences, an array over positions in each, so that joining is a shift of a
sorted array and a task sees one block at a time.  In a block groups have small numbers of their own; what is
shuffled for the counts is one row for each group of a block, never an occurrence.  A frequent group gets a number that holds for
the whole corpus, and a longer group is the pair of its two shorter ones, so groups are compared exactly, without hashing.
The semi join reads the frequent groups from a broadcast while they are few, and meets them by a shuffle beyond that.
"""

import itertools
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagescan.llm.common import dropped, kept, shared_folder, small, stored, valid_text

#: Occurrences of a phrase that make it a candidate, and words of the longest phrase.
LEAST, LONGEST = 30, 4
#: A phrase goes where this share (in percent) of its occurrences lies inside one longer phrase.
INSIDE = 80
SCORE = 2_000_000
#: Phrases reported for each language.
TOP = 2000
#: Words (and ends of pieces) in a block.
BLOCK = 1 << 19
#: Frequent groups up to which they are broadcast, at 24 bytes each, and frequent words, at some 100 bytes each.
FEW, FEW_WORDS = 2_000_000, 500_000
_CHUNK = 1 << 20
#: Ends of pieces become a full stop, blanks a blank, and ASCII capitals small letters.
_TABLE = bytes(46 if chr(c) in ".,;:!?\n\v\f\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_END = b"."


def tokens(text: bytes):
    """Lists of the words of a text, lower-cased, with a full stop at each end of a piece; about a megabyte at a time."""
    data, start = text.translate(_TABLE), 0
    while start < len(data):
        stop = data.find(b" ", start + _CHUNK)
        stop = len(data) if stop < 0 else stop
        yield [t for t in data[start:stop].replace(_END, b" . ").split(b" ") if t]
        start = stop


class _Words:
    """The block that a task is at: numbers of its words (per language) and the words in order, -1 where a piece ends."""

    def __init__(self):
        self.numbers, self.parts, self.size = {}, [], 0
        self.next = itertools.count().__next__

    def add(self, lang: str, found: list[bytes]) -> None:
        known = self.numbers.get(lang)
        if known is None:
            known = self.numbers[lang] = defaultdict(self.next, {_END: -1})
        self.parts.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
        self.size += len(found)


def _packed(numbers: np.ndarray) -> bytes:
    return pa.compress(numbers.astype(np.int32).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=4 * size, codec="zstd", asbytes=True), np.int32)


_GROUPS = 1 << 18


def _first_blocks(with_relation: bool):
    """Occurrences of words: the groups of each block (a row each), with its relation (one row, ``local`` -1) or, without it, the number of
    its words in each language (a row without a word)."""
    def block(words, number):
        ids = np.concatenate([*words.parts, np.zeros(0, np.int32)])
        counts = np.bincount(ids[ids >= 0])
        for lang, known in words.numbers.items():
            del known[_END]
            total = 0
            for start in range(0, len(known), _GROUPS):
                local = np.fromiter(itertools.islice(known.values(), start, start + _GROUPS), np.int32)
                total += int(counts[local].sum())
                yield record(np.full(len(local), number), local, [lang] * len(local), [
                    w.decode() for w in itertools.islice(known, start, start + _GROUPS)], counts[local], [None] * len(local))
            if not with_relation:
                yield record([number], [0], [lang], [None], [total], [None])
        if with_relation:
            yield record([number], [-1], [None], [None], [len(ids)], [_packed(ids)])

    def record(block_, local, lang, word, n, relation):
        return pa.record_batch([pa.array(block_, pa.int64()), pa.array(local, pa.int32()), pa.array(lang, pa.string()),
                                pa.array(word, pa.string()), pa.array(n, pa.int64()), pa.array(relation, pa.binary())],
                               names=["block", "local", "lang", "word", "n", "relation"])

    def run(batches):
        number, words = TaskContext.get().partitionId() << 32, _Words()
        for lang, found, ends in _pieces(batches, lambda: words.size):
            words.add(lang, found)
            if ends:
                yield from block(words, number)
                number, words = number + 1, _Words()
        if words.size:
            yield from block(words, number)

    return run


def _pieces(batches, size):
    """(language, words, whether a block ends behind them) for texts with their languages; blocks end with a piece."""
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            lang = lang.as_py()
            # A document's end is the end of its last piece.
            for found in itertools.chain(tokens(text.as_py() or b""), [[_END]]):
                if size() + len(found) >= BLOCK and _END in found:
                    cut = len(found) - found[::-1].index(_END)
                    yield lang, found[:cut], True
                    found = found[cut:]
                yield lang, found, False


class _Known(dict):
    """Numbers of the frequent words; anything else is -1."""

    def __missing__(self, word):
        return -1


def _known_words(sent):
    """Relations of the frequent words, whose numbers come from a broadcast by language."""
    def run(batches):
        known, none = {lang: _Known(words) for lang, words in sent.value.items()}, _Known()
        number, parts, size = TaskContext.get().partitionId() << 32, [], 0

        def done():
            every = np.concatenate(parts)
            live = every >= 0
            ids, place = np.unique(every[live], return_inverse=True)
            relation = np.full(len(every), -1, np.int32)
            relation[live] = place
            return _relation(number, ids, relation)

        for lang, found, ends in _pieces(batches, lambda: size):
            parts.append(np.fromiter(map(known.get(lang, none).__getitem__, found), np.int64, len(found)))
            size += len(found)
            if ends:
                yield done()
                number, parts, size = number + 1, [], 0
        if size:
            yield done()

    return run


_RELATION = "block LONG, ids BINARY, relation BINARY, size LONG"


def _relation(block: int, ids: np.ndarray, relation: np.ndarray) -> pa.RecordBatch:
    """One row: a block's relation, whose numbers are places in ``ids``, the block's frequent groups, or -1."""
    return pa.record_batch([pa.array([block], pa.int64()), pa.array([ids.astype(np.int64).tobytes()], pa.binary()),
                            pa.array([_packed(relation)], pa.binary()), pa.array([len(relation)], pa.int64())],
                           names=["block", "ids", "relation", "size"])


def _joined(relation: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The merge join with itself: (positions that have a neighbour, pairs of places in ``ids`` as one number)."""
    at = np.flatnonzero((relation[:-1] >= 0) & (relation[1:] >= 0))
    return at, relation[at].astype(np.int64) * max(len(ids), 1) + relation[at + 1]


def _both(pairs: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The corpus numbers of the left and the right group of pairs."""
    return ids[pairs // max(len(ids), 1)], ids[pairs % max(len(ids), 1)]


def _shrunk(block: int, relation: np.ndarray, groups: np.ndarray) -> pa.RecordBatch:
    """The semi join: a relation of group numbers, and for each group its corpus number, or -1 where it is not frequent."""
    live = np.flatnonzero(groups >= 0)
    order = np.full(len(groups) + 1, -1, np.int32)
    order[live] = np.arange(len(live), dtype=np.int32)
    return _relation(block, groups[live], order[relation])


def _read(batch, row: int) -> tuple[int, np.ndarray, np.ndarray]:
    block, ids, relation, size = (batch.column(batch.schema.get_field_index(c))[row].as_py() for c in ("block", "ids", "relation", "size"))
    return block, np.frombuffer(ids or b"", np.int64), _unpacked(relation, size)


def _counted(with_places: bool):
    """The groups of the next length of each block: ``left, right, n``, or ``block, local, left, right``."""
    def run(batches):
        for batch in batches:
            for row in range(len(batch)):
                block, ids, relation = _read(batch, row)
                groups, counts = np.unique(_joined(relation, ids)[1], return_counts=True)
                for start in range(0, len(groups), _GROUPS):
                    cut = slice(start, start + _GROUPS)
                    left, right = _both(groups[cut], ids)
                    if with_places:
                        yield pa.record_batch([pa.array(np.full(len(left), block)), pa.array(np.arange(start, start + len(left), dtype=np.int32)),
                                               pa.array(left), pa.array(right)], names=["block", "local", "left", "right"])
                    else:
                        yield pa.record_batch([pa.array(left), pa.array(right), pa.array(counts[cut])], names=["left", "right", "n"])

    return run


def _longer(relation: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(relation of the next length by group number, -1 where there is none; its groups)."""
    at, pairs = _joined(relation, ids)
    groups, inverse = np.unique(pairs, return_inverse=True)
    out = np.full(len(relation), -1, np.int32)
    out[at] = inverse
    return out, groups


def _semi_join_here(sent):
    """Relations of the next length, frequent groups from a broadcast of (left numbers, right numbers, sorted pairs, ids)."""
    def run(batches):
        lefts, rights, pairs, numbers = sent.value
        for batch in batches:
            for row in range(len(batch)):
                block, ids, relation = _read(batch, row)
                out, groups = _longer(relation, ids)
                left, right = _both(groups, ids)
                i, j = np.searchsorted(lefts, left), np.searchsorted(rights, right)
                i, j = np.minimum(i, len(lefts) - 1), np.minimum(j, len(rights) - 1)
                key = i * len(rights) + j
                k = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
                found = (lefts[i] == left) & (rights[j] == right) & (pairs[k] == key) if len(pairs) else np.zeros(len(groups), bool)
                yield _shrunk(block, out, np.where(found, numbers[k], -1) if len(pairs) else np.full(len(groups), -1))

    return run


def _semi_join_shuffled(first: bool):
    """Relations without infrequent groups, from rows by block: the relation (``local`` -1), then its frequent groups, ``local`` to ``id``.

    The first relation has words by number; later ones are joined to the next length here.
    """
    def run(batches):
        now, locals_, ids = None, [], []

        def done():
            block, known, relation = now
            if first:
                size = int(relation.max(initial=-1)) + 1
            else:
                relation, groups = _longer(relation, known)
                size = len(groups)
            numbers = np.full(size, -1, np.int64)
            if locals_:
                numbers[np.concatenate(locals_)] = np.concatenate(ids)
            return _shrunk(block, relation, numbers)

        for batch in batches:
            block, local, number = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("block", "local", "id"))
            edge = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (local[1:] < 0)) + 1), len(block)]
            for start, stop in zip(edge, edge[1:]):
                if start < stop and local[start] < 0:
                    if now is not None:
                        yield done()
                    now, locals_, ids = _read(batch, start), [], []
                    start += 1
                if start < stop:
                    locals_.append(local[start:stop])
                    ids.append(number[start:stop].astype(np.int64))
        if now is not None:
            yield done()

    return run


def _numbered(groups: DataFrame) -> DataFrame:
    """Groups with ``id``: small numbers without order, which take little room in a shuffle."""
    groups = kept(groups)
    parts, place = groups.rdd.getNumPartitions(), F.monotonically_increasing_id()
    # The place in the partition, then the partition.
    number = place.bitwiseAND((1 << 33) - 1) * parts + F.shiftright(place, 33)
    return kept(groups.select(number.alias("id"), *groups.columns))


def _frequent(groups: DataFrame, key: list[str], least: int) -> DataFrame:
    """``id, key, f``: the groups that occur ``least`` times or more in all blocks, numbered."""
    return _numbered(groups.groupBy(*key).agg(F.sum("n").alias("f")).where(F.col("f") >= least))


def _meeting(relations: DataFrame, groups: DataFrame, frequent: DataFrame, key: list[str], first: bool) -> DataFrame:
    """The semi join by a shuffle: each block's relation meets its frequent groups."""
    met = groups.join(small(frequent.select("id", *key)), key).select(
        "block", "local", "id", *[F.lit(None).cast(kind).alias(c) for c, kind in (("ids", "binary"), ("relation", "binary"), ("size", "long"))])
    alone = relations.select("block", F.lit(-1).alias("local"), F.lit(0).cast("long").alias("id"), "ids", "relation", "size")
    by_block = alone.unionByName(met).repartition("block").sortWithinPartitions("block", "local")
    return by_block.mapInArrow(_semi_join_shuffled(first), _RELATION)


def _next(relations: DataFrame, frequent: DataFrame) -> DataFrame:
    """The relations of the next length, frequent groups only."""
    if frequent.limit(FEW + 1).count() > FEW:
        groups = relations.mapInArrow(_counted(True), "block LONG, local INT, left LONG, right LONG")
        return _meeting(relations, groups, frequent, ["left", "right"], False)
    table = frequent.select("left", "right", "id").toArrow()
    left, right, number = (table.column(c).to_numpy() for c in ("left", "right", "id"))
    lefts, rights = np.unique(left), np.unique(right)
    pairs = np.searchsorted(lefts, left) * len(rights) + np.searchsorted(rights, right)
    order = np.argsort(pairs)
    sent = relations.sparkSession.sparkContext.broadcast((lefts, rights, pairs[order], number[order]))
    return relations.mapInArrow(_semi_join_here(sent), _RELATION)


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, list[DataFrame]]:
    """(``lang, n``: words of each language; for each length the frequent phrases).

    Phrases have ``id, lang, phrase, f``, the ids ``left`` and ``right`` of the phrases without the last and the first word, and
    ``prefixes`` and ``suffixes``: how often the first and the last 1, 2, ... words of the phrase occur.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/collocations-{uuid.uuid4()}"
    rows = docs.select(F.coalesce(valid_text("lang"), F.lit("und")).alias("lang"), valid_text().cast("binary").alias("text"))
    words = "block LONG, local INT, lang STRING, word STRING, n LONG, relation BINARY"
    counts = kept(rows.mapInArrow(_first_blocks(False), words).groupBy("lang", "word").agg(F.sum("n").alias("f")).where(
        F.col("word").isNull() | (F.col("f") >= least)))
    totals = counts.where("word IS NULL").select("lang", F.col("f").alias("n"))
    frequent = _numbered(counts.where("word IS NOT NULL").select("lang", "word", "f"))
    found = [frequent.select("id", "lang", F.col("word").alias("phrase"), "f", F.lit(None).cast("long").alias("left"),
                             F.lit(None).cast("long").alias("right"), F.col("word").alias("last"),
                             F.array("f").alias("prefixes"), F.array("f").alias("suffixes"))]
    if frequent.limit(FEW_WORDS + 1).count() <= FEW_WORDS:
        numbers = {}
        for lang, word, number in zip(*(c.to_pylist() for c in frequent.select("lang", "word", "id").toArrow().columns)):
            numbers.setdefault(lang, {})[word.encode()] = number
        relations = stored(rows.mapInArrow(_known_words(spark.sparkContext.broadcast(numbers)), _RELATION), f"{folder}/1")
    else:
        blocks = stored(rows.mapInArrow(_first_blocks(True), words), f"{folder}/words")
        whole = blocks.where("local < 0").select("block", F.lit(None).cast("binary").alias("ids"), "relation", F.col("n").alias("size"))
        groups = blocks.where("local >= 0").select("block", "local", "lang", "word")
        relations = stored(_meeting(whole, groups, frequent, ["lang", "word"], True), f"{folder}/1")
        dropped(spark, f"{folder}/words")
    for length in range(2, longest + 1):
        frequent = _frequent(relations.mapInArrow(_counted(False), "left LONG, right LONG, n LONG"), ["left", "right"], least)
        shorter = found[-1]
        first = shorter.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("_first"), "prefixes")
        last = shorter.select(F.col("id").alias("right"), F.col("last"), "suffixes")
        found.append(kept(frequent.join(small(first), "left").join(small(last), "right").select(
            "id", "lang", F.concat_ws(" ", "_first", "last").alias("phrase"), "f", "left", "right", "last",
            F.array_append("prefixes", F.col("f")).alias("prefixes"), F.array_append("suffixes", F.col("f")).alias("suffixes"))))
        if length < longest:
            relations = stored(_next(relations, frequent), f"{folder}/{length}")
            dropped(spark, f"{folder}/{length - 1}")
    dropped(spark, folder)
    return totals, found


def _scored(phrases: DataFrame, length: int) -> DataFrame:
    """``id, lang, phrase, a, l, r, score`` by the lowest-scoring cut, of ties the first."""
    wide = "DECIMAL(38,0)"
    cuts = [f"named_struct('score', CAST(CAST({SCORE} AS DECIMAL(10,0)) * CAST(f AS DECIMAL(20,0)) AS {wide}) div "
            f"(CAST(prefixes[{k - 1}] AS {wide}) + CAST(suffixes[{length - k - 1}] AS {wide})), "
            f"'k', {k}, 'l', prefixes[{k - 1}], 'r', suffixes[{length - k - 1}])" for k in range(1, length)]
    return phrases.select("id", "lang", "phrase", "f", F.expr(f"array_min(array({', '.join(cuts)}))").alias("cut")).select(
        "id", "lang", "phrase", F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
        F.col("cut.score").cast("long").alias("score"))


def _not_inside(scored: DataFrame, longer: DataFrame | None) -> DataFrame:
    """Without the phrases most of whose occurrences lie in one longer phrase.

    A phrase inside one longer by two words is also inside the part of that which is longer by one, which occurs as often
    or more, so the next length decides.
    """
    if longer is None:
        return scored
    most = longer.select(F.explode(F.array("left", "right")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("most"))
    wide = "DECIMAL(38,0)"
    return scored.join(small(kept(most)), "id", "left").where(
        f"most IS NULL OR CAST(100 AS DECIMAL(10,0)) * CAST(most AS DECIMAL(20,0)) < CAST({INSIDE} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0))")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language from ``docs(text, lang)``.

    A phrase has 2 to ``longest`` words, a is how often it occurs, l and r how often the two parts of its worst cut do, n the words
    of the language; ranks are by score, then a, then the phrase's bytes.  NULL texts are empty; a NULL lang is ``und``, as is a
    language of that name.  Empty pieces and blanks give no words; a very long text runs through in pieces, and repeated rows count
    as often as they are there.  Bytes that are no UTF-8 count as U+FFFD.  An empty table gives no rows.  Other columns are not read.
    """
    totals, found = mine(docs, least, longest)
    candidates = None
    for length in range(2, longest + 1):
        scored = _not_inside(_scored(found[length - 1], length), found[length] if length < longest else None).select(
            "lang", "phrase", "a", "l", "r", "score")
        candidates = scored if candidates is None else candidates.unionByName(scored)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First the best of each of many parts of a language, so that no task ranks a whole one.
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    best = candidates.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(small(totals), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
