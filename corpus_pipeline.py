"""From raw documents to training shards: the stages, and a run over all of them.

Every stage takes ``(spark, docs, sf_dir)`` and returns the documents it keeps with their columns; the
last adds the shard.  Between stages the documents are written as Parquet and read again.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescan.llm import decontaminate, mixing, quality, sharding, simhash
from pagescan.llm.common import documents, shared_folder

#: SQL cannot express the fingerprints and shards of stages 2 and 5; tests hold the run against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; frequent lines go out of the texts of the others."""
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of SimHash links the document with the least doc_id stays."""
    return simhash.deduplicate(docs)


def _wrapped(docs: DataFrame) -> DataFrame:
    """What an operator reads, and the whole row as one column, so that no column of a user's meets its own."""
    return docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", "source")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    found = decontaminate.search(_wrapped(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["_row"])
    return found.where("size(item_ids) = 0").select("_row.*")


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target wants it, which may be never."""
    mixed = mixing.mix(_wrapped(docs), keep=["_row"])
    return mixed.select("_row", F.explode(F.expr("IF(copies > 0, sequence(1, copies), array())"))).select("_row.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard and slot; columns of theirs with the names of results give way."""
    placed = sharding.shard(_wrapped(docs), keep=["_row"])
    new = placed.drop("_row", "doc_id").columns
    return placed.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in new], *new)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("target_weights", target_weights), ("shards", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written to the shared folder and read again."""
    docs, folder = documents(spark, sf_dir), f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs.write.parquet(f"{folder}/{number}-{name}")
            docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
