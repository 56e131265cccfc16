"""What several operators share: word pattern, checked broadcasts, cut lineage, connected components."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescan.sources.folders import shared_folder

#: Runs of white space as every operator here splits on (blank, tab, LF, VT, FF, CR).
SPACE = r"[\x20\x09-\x0D]+"
#: Rows up to which a side of a join may be broadcast; its count is taken first.
BROADCAST_ROWS = 500_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text) -> Column:
    """The words of a text as an array; none for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text) -> Column:
    """How many words a text has, without cutting it into pieces.

    Each run of other characters becomes one mark, so the marks are the words.
    """
    return F.length(F.regexp_replace(F.regexp_replace(
        F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]++", "x"), r"[\x20\x09-\x0D]++", "")).cast("long")


def valid_text(column="text") -> Column:
    """The text for a Python worker: what is no UTF-8 becomes U+FFFD, as any string column may hold any bytes."""
    return F.make_valid_utf8(F.col(column).cast("string"))


def stored(df: DataFrame, folder: str) -> DataFrame:
    """The rows written as Parquet into ``folder`` and read again; smaller than a checkpoint for wide tables."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def dropped(spark: SparkSession, folder: str) -> None:
    """Takes away a folder that ``stored`` wrote, once nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, so that a lost executor costs no recomputation and two
    readers see the same rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, weight: str | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it is counted as small; else the join stays a shuffle join.

    ``df`` should be cheap to count: a kept table or an aggregate of few groups.  Rows with arrays count as
    the SQL expression ``weight`` says.
    """
    if weight is None:
        found = df.limit(BROADCAST_ROWS + 1).count()
    else:
        found = df.agg(F.sum(F.expr(weight))).first()[0] or 0
    return F.broadcast(df) if found <= BROADCAST_ROWS else df


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node of an undirected graph: root is the least node it is connected with.

    Large-star and small-star steps in turn, until nothing changes.  A step sends no more rows
    than there are edges, sums up before the shuffle and is kept in the checkpoint folder; a node
    with very many neighbours is a skewed key of a join of two kept tables, which Spark splits.
    """
    def with_least(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        least = kept(pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        return least, pairs.join(least, "u")

    def large_star(pairs: DataFrame) -> DataFrame:
        # Larger neighbours go to the least of the whole neighbourhood.
        _, joined = with_least(kept(pairs.unionByName(pairs.selectExpr("v AS u", "u AS v"))))
        return joined.where("v > u").selectExpr("v AS u", "m AS v")

    def small_star(pairs: DataFrame) -> DataFrame:
        # A node and its smaller neighbours go to the least of them.
        least, joined = with_least(pairs)
        return joined.where("v != m").selectExpr("v AS u", "m AS v").unionByName(
            least.selectExpr("u", "m AS v"))

    now = kept(edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before, state = None, None
    while before is None or state != before:
        before = state or (0, None)
        now = kept(small_star(kept(large_star(now).distinct())).distinct())
        state = tuple(now.agg(F.count("*"), F.expr("sum(CAST(xxhash64(u, v) AS DECIMAL(20)))")).first())
    return now.selectExpr("u AS node", "v AS root")
