"""Rows to shards by jump consistent hashing, and gapless places inside each shard.

The hash of a row's id and the number of shards decide its shard, without a table of ring
positions; one shard more takes 1/(n+1) of the rows, and only into itself.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagescan.llm.common import small

#: Rows that one task numbers at a time; a shard is numbered in pieces of about this size.
PIECE_ROWS = 50_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of unsigned 64-bit keys (Lamping and Veach, 2014), for all keys at once."""
    key, at = keys.astype(np.uint64), np.full(len(keys), -1, np.int64)
    ahead = np.zeros(len(keys), np.int64)
    going = np.flatnonzero(ahead < shards)
    while len(going):
        at[going] = ahead[going]
        key[going] = key[going] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((key[going] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[going] = ((at[going] + 1) * step).astype(np.int64)
        going = going[ahead[going] < shards]
    return at.astype(np.int32)


def jump_hash(key, shards: int):
    """Column: the shard of a long key."""
    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards))

    return place(key)


def shard(docs: DataFrame, shards: int = 24, key: str = "doc_id", keep=()) -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard`` and the columns in ``keep``, a row per row.

    size is the text's UTF-8 bytes plus 8; NULL texts count as empty.  shard depends on the key
    and the number of shards only; grown_shard is the place with one shard more, which is either
    the same or the new one.  slot counts from 0 in each shard without gaps, in an order fixed by
    the rows' values, so reruns agree; a larger table is numbered in other pieces, so slots (not shards) of old rows change when it
    grows.  Rows with a NULL key go where a key of its own goes.  Equal
    rows are counted before they are dealt and spread out again at the end, so a key that holds
    very many equal rows is one row on the way.  Columns of the input with the names of results
    are not read, unless in ``keep``, which must not name results.

    Numbering needs no task that sees a whole shard: rows fall into pieces by hash, pieces are
    counted, and a row's slot is the count of all earlier pieces plus its place in its own.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mark = F.xxhash64(F.lit("shard"), F.col(key).cast("string"))
    columns = [key, *[c for c in keep if c != key]]
    rows = docs.select(*columns, (F.octet_length(text).cast("long") + 8).alias("size"),
                       F.crc32(text).alias("text_crc32"), mark.alias("_mark"))
    pieces = max(64, docs.count() // (shards * PIECE_ROWS))
    plain = [*columns, "size", "text_crc32"]
    grouped = (rows.groupBy(*plain, "_mark").agg(F.count("*").alias("_rows"))
               .withColumn("shard", jump_hash(F.col("_mark"), shards))
               .withColumn("grown_shard", jump_hash(F.col("_mark"), shards + 1))
               .withColumn("_piece", F.pmod(F.xxhash64("_mark", "text_crc32", "size"), F.lit(pieces))))
    # Counted from the ids alone: the count does not carry texts.
    counts = (rows.select("_mark", "text_crc32", "size").groupBy("_mark", "text_crc32", "size").count()
              .withColumn("shard", jump_hash(F.col("_mark"), shards))
              .withColumn("_piece", F.pmod(F.xxhash64("_mark", "text_crc32", "size"), F.lit(pieces)))
              .groupBy("shard", "_piece").agg(F.sum("count").alias("_in_piece")))
    before = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_piece", F.coalesce(F.sum("_in_piece").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("shard", "_piece").orderBy(*plain).rowsBetween(Window.unboundedPreceding, -1)
    placed = grouped.withColumn("_first", F.coalesce(F.sum("_rows").over(inside), F.lit(0))).join(
        small(offsets), ["shard", "_piece"])
    return placed.select(*columns, "size", "text_crc32", F.lit("key").alias("law"), "shard", "grown_shard",
                         F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1)).alias("_nth"),
                         (F.col("_base") + F.col("_first")).alias("_at")) \
        .select(*columns, "size", "text_crc32", "law", "shard", (F.col("_at") + F.col("_nth")).alias("slot"),
                "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> None:
    """The documents as Parquet, one folder per shard, with their slots."""
    keep = [c for c in docs.columns if c not in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")]
    shard(docs, shards, keep=keep).write.partitionBy("shard").parquet(path)
