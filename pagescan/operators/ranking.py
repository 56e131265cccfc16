"""Row numbers within large groups."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that rows are dealt to, and sampled rows from which their bounds come.
RANGES, SAMPLE = 256, 8192


def _key(group: str | None, order) -> F.Column:
    """A struct that sorts as the numbering does; ``-name`` is a number by falling value."""
    parts = [F.col(group) if group else F.lit(0)]
    parts += [-F.col(c[1:]) if c.startswith("-") else F.col(c) for c in order]
    return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])


def _range_of(bounds: str, key: str) -> str:
    """SQL: how many of the sorted bounds are below the key, by halving."""
    steps = RANGES.bit_length()
    middle = "CAST((s.low + s.high) div 2 AS INT)"
    return (f"aggregate(sequence(1, {steps}), named_struct('low', 0, 'high', size({bounds})), (s, i) -> "
            f"CASE WHEN s.low >= s.high THEN s WHEN {bounds}[{middle}] < {key} THEN named_struct('low', {middle} + 1, 'high', s.high) "
            f"ELSE named_struct('low', s.low, 'high', {middle}) END, s -> s.low)")


def numbered(df: DataFrame, group: str | None, *order: str, name: str = "no") -> DataFrame:
    """Number the rows of each ``group`` (or all rows) in ``order``, from 1.

    A window would bring a whole group into one task, and a report section can be most of the data.  Rows are
    dealt to ranges of the sort key instead; a row's number is its place in its range and group, plus the
    rows of its group in earlier ranges, of which there is one count for each range and group.  Bounds are
    taken from the rows with the least hashes, so they follow from the rows and nothing needs to be written:
    whatever computes a row's range, the counts or the numbers, gets the same one.

    Equal rows are counted first and take neighbouring numbers.  Nothing runs before an action, and sides are broadcast
    only where Spark has seen that they are small.
    """
    columns = df.columns
    rows = df.groupBy(*columns).agg(F.count("*").alias("_copies")).withColumn("_key", _key(group, order))
    # The number of copies stands in the order so that the bounds read the same aggregate as the rest, of which one shuffle serves all.
    least = rows.select("_key", "_copies", F.xxhash64("_key").alias("_hash")).orderBy("_hash", "_key", "_copies").limit(SAMPLE)
    every = least.agg(F.array_sort(F.collect_list("_key")).alias("all"))
    bounds = every.select(F.expr(
        f"filter(all, (x, i) -> i > 0 AND (i * {RANGES - 1}) div size(all) != ((i - 1) * {RANGES - 1}) div size(all))"))
    placed = rows.withColumn("_bounds", bounds.scalar()).withColumn("_range", F.expr(_range_of("_bounds", "_key"))).drop("_bounds")
    placed = placed.withColumn("_group", F.col("_key.k0"))
    counts = placed.groupBy("_group", "_range").agg(F.sum("_copies").alias("_rows"))
    earlier = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_group").alias("_of"), F.col("_range").alias("_at"),
                            F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_group", "_range").orderBy("_key", *columns).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(offsets, F.col("_group").eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_at")))
    first = F.col("_before") + F.coalesce(F.sum("_copies").over(inside), F.lit(0))
    return joined.select(*columns, first.alias("_first"), "_copies").select(
        *columns, F.explode(F.sequence(F.col("_first") + 1, F.col("_first") + F.col("_copies"))).alias(name))
