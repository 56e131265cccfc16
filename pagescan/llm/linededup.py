"""Line de-duplication by deletion neighbourhoods: of lines within one edited word the earliest stays.

A line is its words, lower-cased.  Equal lines meet by hash.  Two different lines are near if one
word is exchanged, inserted or left out and both have ``LEAST_WORDS`` words or more.  Every line
emits a hashed key for each variant with one word deleted: variants of the same place and length
meet where a word is exchanged, and a line meets the variants of longer lines that it equals.
Variants are emitted only by lines that share their first or their last half with another line,
which near lines must.  In a group only the earliest line is paired with each other one, so a
template with thousands of fillings gives as many pairs, not their square.

Everything is Spark expressions; what is shuffled are hashes and places, and the words of lines that have variants.
"""

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescan.functions.text import let
from pagescan.llm.common import SPACE, dropped, kept, shared_folder, small, stored

LEAST_WORDS = 5
#: Sums of hashes are taken modulo this prime, so that no line is too long for a long.
_PRIME = (1 << 61) - 1


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, th, no, line`` (th: the text's hash), for lines with a word."""
    return docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("th"),
                       F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("no", "line")) \
        .where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _place() -> Column:
    return F.struct("doc_id", "th", "no")


def _normal() -> Column:
    """The words of ``line``, lower-cased, one blank between them."""
    low = F.lower("line")
    return F.when(low.rlike(r"[\x09-\x0D]|\x20\x20|^\x20|\x20$"), F.trim(F.regexp_replace(low, SPACE, " "))).otherwise(low)


def _half_keys() -> list[Column]:
    """Keys ``h0`` to ``h3`` of the halves of ``norm`` (``n`` words) that a near line must share: two of the first half, then two
    of the last; NULL for short lines.

    The shorter line's length gives the half, so a line of n words has halves of n and of n - 1.
    """
    keys = []
    for side in ("first", "last"):
        for size in ("n", "(n - 1)"):
            half = f"substring_index(norm, ' ', {'' if side == 'first' else '-'}CAST({size} div 2 AS INT))"
            keys.append(F.expr(f"IF(n < {LEAST_WORDS}, NULL, xxhash64('{side}', {size}, {half})) AS h{len(keys)}"))
    return keys


def _sums(array: str) -> str:
    """For each position the sum of all before it; blocks of sqrt(n), so long lines do not cost n * n."""
    def total(numbers):
        return f"aggregate({numbers}, 0L, (a, b) -> (a + b) % {_PRIME}L)"

    def from_width(v):
        blocks = (f"transform(sequence(0, CAST((size({v}.x) - 1) div {v}.width AS INT)), b -> "
                  + total(f"slice({v}.x, b * {v}.width + 1, {v}.width)") + ")")
        def from_blocks(s):
            bases = f"transform({s}.sums, (y, b) -> {total(f'slice({s}.sums, 1, b)')})"
            return let(lambda t: (f"transform({v}.x, (y, i) -> {t}.bases[CAST(i div {v}.width AS INT)] + "
                                  + total(f"slice({v}.x, CAST(i div {v}.width AS INT) * {v}.width + 1, i % {v}.width)") + ")"),
                       bases=bases)
        return let(from_blocks, sums=blocks)
    return let(lambda v: let(from_width, x=f"{v}.x", width=f"CAST(ceil(sqrt(size({v}.x))) AS INT)"), x=array)


def _variant_keys() -> str:
    """SQL array of (kind, key): 1 for a word exchanged, 2 for one deleted, 3 for the whole line.

    A line's hash is the sum of a hash of each word with its place, so a variant's hash is the sum
    before the word and the sum behind it, there with places one less.  The edit lies outside the
    half that is shared, so a line that shares its first half only has variants of the rest.
    """
    def terms(shift):
        return f"transform(words, (w, i) -> pmod(xxhash64(w, i - {shift}), {_PRIME}L))"

    def keys(v):
        n = f"{v}.n"
        exchange = f"named_struct('kind', 1, 'key', xxhash64('x', {n}, i, pmod({v}.total - {v}.plain[i], {_PRIME}L)))"
        delete = (f"named_struct('kind', 2, 'key', xxhash64('d', {n} - 1, pmod({v}.before[i] + "
                  f"pmod({v}.moved_total - {v}.moved_before[i] - {v}.moved[i], {_PRIME}L), {_PRIME}L)))")
        whole = f"named_struct('kind', 3, 'key', xxhash64('d', {n}, {v}.total))"
        # Halves of n - 1 words are the smallest a partner can share.
        start = f"IF(sides = 1, CAST(({n} - 1) div 2 AS INT), 0)"
        stop = f"IF(sides = 2, {n} - 1 - CAST(({n} - 1) div 2 AS INT), {n} - 1)"
        return (f"array_append(array_distinct(flatten(transform(sequence({start}, {stop}), i -> array({exchange}, {delete})))), {whole})")

    total = f"aggregate({{}}, 0L, (p, q) -> (p + q) % {_PRIME}L)"
    return let(lambda v: let(keys, n="size(words)", plain=f"{v}.plain", moved=f"{v}.moved", total=total.format(f"{v}.plain"),
                             moved_total=total.format(f"{v}.moved"), before=_sums(f"{v}.plain"), moved_before=_sums(f"{v}.moved")),
               plain=terms(0), moved=terms(1))


def _within_one(a: str, b: str) -> str:
    """Whether two word arrays differ by one exchanged, inserted or missing word at most."""
    def same(v):
        def ends(u):
            front = f"array_position(zip_with({u}.s, slice({u}.l, 1, size({u}.s)), (x, y) -> x = y), false)"
            back = (f"array_position(zip_with(reverse({u}.s), slice(reverse({u}.l), 1, size({u}.s)), (x, y) -> x = y), false)")
            full = f"IF({{0}} = 0, size({u}.s), {{0}} - 1)"
            return (f"size({u}.l) - size({u}.s) <= 1 AND {full.format(front)} + {full.format(back)} >= "
                    f"size({u}.s) - IF(size({u}.l) = size({u}.s), 1, 0)")
        return let(ends, s=f"IF(size({v}.a) <= size({v}.b), {v}.a, {v}.b)", l=f"IF(size({v}.a) <= size({v}.b), {v}.b, {v}.a)")
    return let(same, a=a, b=b)


def _involved(places: DataFrame) -> DataFrame:
    """``hash, place, sides`` of the distinct lines that share a half with another one: first place, and which halves."""
    halves = places.where("h0 IS NOT NULL").select("hash", F.expr("stack(4, 1, h0, 1, h1, 2, h2, 2, h3) AS (side, key)"))
    # A key is shared if two different lines have it.
    shared = kept(halves.groupBy("key").agg(F.min("hash").alias("low"), F.max("hash").alias("high")).where(
        "low != high").select("key"))
    sides = kept(halves.join(small(shared), "key", "left_semi").groupBy("hash").agg(F.expr("bit_or(side) AS sides")))
    return kept(places.join(small(sides), "hash").groupBy("hash").agg(
        F.min(_place()).alias("place"), F.min("sides").alias("sides")))


def _near(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``hash`` of the distinct lines for which there is an earlier near line."""
    involved = small(_involved(places)).withColumnRenamed("place", "_place")
    texts = kept(_lines(docs).join(involved, _place() == F.col("_place")).select(
        "hash", F.col("_place").alias("place"), "sides", _normal().alias("norm")).distinct())
    variants = kept(texts.select("hash", "sides", F.split("norm", " ").alias("words")).select(
        "hash", F.explode(F.expr(_variant_keys())).alias("v")).select("hash", "v.kind", "v.key"))
    # Most variants are nobody else's; only shared keys go on.
    common = kept(variants.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    met = kept(variants.join(small(common), "key", "left_semi").join(small(texts.select("hash", "place")), "hash").select(
        "key", "kind", F.struct("place", "hash").alias("at")))
    exchange = met.where("kind = 1")
    first = kept(exchange.groupBy("key").agg(F.min("at").alias("early")))
    pairs = exchange.join(small(first), "key").where("at.hash != early.hash").select("at.hash", "early")
    whole = met.where("kind = 3").select("key", F.col("at").alias("whole"))
    longer = met.where("kind = 2").select("key", F.col("at").alias("longer")).join(whole, "key").where("longer.hash != whole.hash")
    pairs = pairs.unionByName(longer.select(
        F.greatest("longer", "whole").getField("hash").alias("hash"), F.least("longer", "whole").alias("early")))
    earliest = kept(pairs.groupBy("hash").agg(F.min("early").alias("early")))
    # Verified on the words themselves.
    words = texts.select("hash", F.split("norm", " ").alias("words"))
    return earliest.join(words, "hash").select("hash", F.col("words").alias("mine"), F.col("early.hash").alias("other")).join(
        words.select(F.col("hash").alias("other"), F.col("words").alias("theirs")), "other").where(
        F.expr(_within_one("mine", "theirs"))).select("hash")


def _gone(docs: DataFrame) -> DataFrame:
    """``_doc, _th, n_exact, n_near, gone``: for documents that lose lines, the numbers of those.

    The lines are cut, normalised and hashed once, into a stored table of numbers; what follows reads that.  Only lines that
    stand twice or are near another one go into joins.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4()}"
    hashed = _lines(docs).select("doc_id", "th", "no", _normal().alias("norm")).select(
        "doc_id", "th", "no", "norm", F.expr("length(norm) - length(replace(norm, ' ', '')) + 1 AS n"))
    places = stored(hashed.select("doc_id", "th", "no", F.xxhash64("norm").alias("hash"), *_half_keys()), folder)
    again = kept(places.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    first = places.join(small(again), "hash").groupBy("hash").agg(F.min(_place()).alias("first"))
    near = _near(docs, places).distinct().select("hash", F.lit(True).alias("near"))
    judged = kept(first.join(near, "hash", "full").select("hash", "first", F.coalesce("near", F.lit(False)).alias("near")))
    # Rows equal in id and text are one document, so their places are equal too.
    marked = places.join(small(judged), "hash").select("doc_id", "th", "no", "near", F.expr(
        "first IS NOT NULL AND named_struct('doc_id', doc_id, 'th', th, 'no', no) != first").alias("exact")).where(
        "exact OR near").distinct()
    gone = kept(marked.groupBy(F.col("doc_id").alias("_doc"), F.col("th").alias("_th")).agg(
        F.expr("count_if(exact) AS n_exact"), F.expr("count_if(NOT exact) AS n_near"), F.collect_list("no").alias("gone")))
    dropped(spark, folder)
    return gone


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, text, n_lines, n_exact, n_near`` for each row of ``docs(doc_id, text)``.

    text is without dropped lines.  A line with a word goes if an equal line stands earlier (by doc_id, NULL first, then
    by the text's hash, then by line), which n_exact counts, or if an earlier line, dropped or not, is
    within one edited word of it (first place of each counts), which n_near counts; n_lines are all
    lines with a word.  Blank lines stay.  NULL texts stay NULL.  Rows equal in doc_id and text are
    one document and share a result.  Other columns are not read.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    left = let(lambda v: f"array_join(transform(array_except(sequence(0, size({v}.l) - 1), gone), i -> {v}.l[i]), '\\n')",
               l="split(text, '\\n')")
    # From the first sign of a word to the line's end: a match for each line with a word.
    n_lines = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D][^\n]*+")), F.lit(0)).cast("long")
    # The same join at every size: texts move once.
    return rows.join(_gone(docs), F.col("th").eqNullSafe(F.col("_th")) & F.col("doc_id").eqNullSafe(
        F.col("_doc")), "left").select(
        "doc_id", F.expr(f"CASE WHEN size(gone) > 0 THEN {left} ELSE text END AS text"), n_lines.alias("n_lines"),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_exact", "n_near")])
