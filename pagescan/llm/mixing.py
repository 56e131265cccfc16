"""Mixing sources to target weights by hash thresholds.

Every document has a hash of its id and text; a source's sizes are summed by hash bucket, and the bucket
in which the budget runs out is refined, and only that, until one hash value is left.  What
lies below the threshold is in; equal rows at it are dealt out by their number.  Nothing is sorted, and a larger budget takes a superset.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagescan.llm.common import kept, small, word_count

#: Bits of the 60-bit hash that each round of histograms resolves.
LEVELS = (12, 16, 16, 16)
_BITS = sum(LEVELS)


def hash60(key) -> F.Column:
    """60 bits of the MD5 of a key's text; NULL counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=(5, 2, 1), most: float = 3.0) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources in order of code points, NULL last, take the weights in turn and share the sum of all
    sizes by weight.  A target stops at ``most`` times its source; the rest goes to the others by
    weight.  The level of water in vessels of width weight and volume cap: the highest of
    (total - caps of the k fullest) / (weights of the others) over all k.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)),
                          (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    full = Window.orderBy("_ratio", F.col("source").isNull(), F.col("source"))
    table = sizes.withColumn("_weight", weight.cast("double")) \
        .withColumn("_cap", F.col("source_size") * F.lit(float(most))) \
        .withColumn("_ratio", F.col("_cap") / F.col("_weight")) \
        .withColumn("_caps", F.coalesce(F.sum("_cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) \
        .withColumn("_open", F.sum("_weight").over(full.rowsBetween(0, Window.unboundedFollowing)))
    everything = Window.partitionBy(F.lit(1))
    table = table.withColumn("_level", (F.sum("source_size").over(everything) - F.col("_caps")) / F.col("_open"))
    level = F.max("_level").over(everything)
    return table.select("source", "source_size", F.least(F.col("_cap"), level * F.col("_weight")).alias("target"))


def thresholds(rows: DataFrame, budget: DataFrame) -> DataFrame:
    """``source, at, left, group``: documents with a hash below ``at`` are in; those at it share ``left``
    words of the ``group`` words they have.  ``at`` is above all hashes where the budget takes all."""
    found = budget.withColumn("_prefix", F.lit(0).cast("long")).withColumn("_left", F.col("need"))
    shift = _BITS
    for bits in LEVELS:
        shift -= bits
        inside = rows.join(small(found.select(F.col("source").alias("_source"), "_prefix")),
                           F.col("source").eqNullSafe(F.col("_source"))
                           & (F.shiftright("h", shift + bits) == F.col("_prefix")))
        sums = inside.groupBy("source", F.shiftright("h", shift).alias("_bucket")).agg(F.sum("size").alias("_sum"))
        by_hash = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        ran = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(by_hash), F.lit(0)))
        # The bucket in which the budget runs out: begun below it, ended at or above it.
        found = kept(found.select(F.col("source").alias("_source"), "need", "_left").join(
            ran, F.col("source").eqNullSafe(F.col("_source")))
            .where("_before < _left AND _before + _sum >= _left")
            .select("source", "need", F.col("_bucket").alias("_prefix"), (F.col("_left") - F.col("_before")).alias("_left"),
                    F.col("_sum").alias("_group")))
    return found.select("source", F.col("_prefix").alias("at"), F.col("_left").alias("left"),
                        F.col("_group").alias("group"))


def _hash(docs: DataFrame, columns) -> F.Column:
    """A row's hash: of its id and its text, and of what else is kept, so that rows of one id spread.

    Rows that are equal in all of that share a hash; maps and the like, which have no hash, do not count.
    """
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    parts = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text]
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    others = [c for c in columns if c not in ("doc_id", "text") and "map" not in kinds[c].simpleString()
              and "variant" not in kinds[c].simpleString()]
    if others:
        parts.append(F.xxhash64(*others).cast("string"))
    return hash60(F.concat_ws(":", *parts))


#: Rows that one task repeats at a time.
_PART = 10_000


def _dealt(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of one hash at the threshold with ``part``: of equal rows as many whole ones as the rest of the budget has, and the last
    words of one more.

    Equal rows are counted, and repeated in parts of bounded size.
    """
    wide = "DECIMAL(38,0)"
    equal = rows.groupBy(*columns).agg(F.count("*").alias("_n"))
    words = f"CAST(round(CAST(left AS {wide}) * (_n * size) / group) AS BIGINT)"
    parts = equal.withColumn("_words", F.expr(words)).withColumn("_from", F.explode(F.expr(
        f"sequence(0L, _n - 1, {_PART}L)"))).repartition(F.col("_from"))
    each = parts.withColumn("_nth", F.explode(F.expr(f"sequence(_from, least(_from + {_PART}L, _n) - 1)")))
    return each.withColumn("_part", F.expr("CAST(CASE WHEN size = 0 THEN 0 ELSE greatest(0L, least(size, _words - _nth * size)) END AS BIGINT)")) \
        .drop("_n", "_words", "_from", "_nth")


def mix(docs: DataFrame, weights=(5, 2, 1), most: float = 3.0, keep=()) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` and the columns in ``keep``, a row per row.

    size counts words (NULL: 0).  A source whose target is q times its size gives every document
    floor(q) times, and once more those whose hash of id and text lies below the source's threshold.
    taken is the number of words, repeats counted: at the threshold itself a document gives the
    words that are still wanted, and of rows equal in everything the first ones theirs whole, so each source
    takes its target but for rounding to a word.  copies counts whole documents: at the threshold
    one more where at least half of it is wanted.  Documents without words take nothing but are
    dealt copies like others.  NULL ids and sources are values like others.  An empty table gives no rows.  Columns called
    like results are not read; ``keep`` must not name results.
    """
    columns = ["doc_id", *[c for c in keep if c != "doc_id"]]
    plain = docs.select(F.struct(*columns).alias("_keep"), F.col("source").alias("_source"),
                        word_count(F.col("text")).alias("size"), _hash(docs, columns).alias("h"))
    rows = kept(plain.select(F.col("_source").alias("source"), "size", "h"))
    sizes = kept(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    shares = kept(targets(sizes, weights, most))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    shares = shares.withColumn("whole", whole.cast("long")) \
        .withColumn("need", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    edge = thresholds(rows, shares.where("need > 0").select("source", "need"))
    plan = kept(shares.alias("s").join(edge.alias("e"), F.expr("s.source <=> e.source"), "left").selectExpr(
        "s.source AS _of", "source_size", "target", "whole", "coalesce(at, -1L) AS at", "left", "group"))
    joined = plain.join(small(plan), F.expr("_source <=> _of")).drop("_source", "_of")
    # Only equal rows share a hash, and only at the threshold do they have to share words.
    several = F.expr("h = at AND size < group")
    one = joined.where(~F.coalesce(several, F.lit(False))).withColumn("_part", F.expr(
        "CASE WHEN h < at THEN size WHEN h = at AND size > 0 THEN least(size, left) ELSE 0L END"))
    shared = _dealt(joined.where(several), joined.columns)
    return one.unionByName(shared).select(
        *[F.col("_keep")[c].alias(c) for c in columns], "size", "source_size", "target",
        (F.col("whole") * F.col("size") + F.col("_part")).alias("taken"),
        (F.col("whole") + F.expr("CASE WHEN h < at OR h = at AND 2 * _part >= size THEN 1L ELSE 0L END"))
        .cast("int").alias("copies"))
