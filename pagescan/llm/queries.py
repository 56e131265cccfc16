"""The registered queries of this subpackage, and their comparison SQL where SQL can express them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescan.llm.collocations import collocations
from pagescan.llm.common import documents
from pagescan.llm.decontaminate import search
from pagescan.llm.language import classify, fit
from pagescan.llm.linededup import dedup_lines
from pagescan.llm.mixing import mix
from pagescan.llm.oracles import ORACLE
from pagescan.llm.orderminhash import edited_likeness
from pagescan.llm.pii import digest, find
from pagescan.llm.quality import judge
from pagescan.llm.sharding import shard
from pagescan.llm.simhash import near_duplicates
from pagescan.llm.url_filters import judge_urls
from pagescan.llm.warc import derive, page_responses
from pagescan.llm.whitening import whiten

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host STRING, path STRING, verdict STRING")
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = "crc32(coalesce(CAST(doc_id AS STRING), '')) % 5 = 0"
    docs = documents(spark, sf_dir)
    model = fit(docs.where(f"NOT ({held_out}) AND lang IS NOT NULL"))
    return classify(docs.select("doc_id", F.expr(f"{held_out} AS held_out"), "text"), model, ["doc_id", "held_out"])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(documents(spark, sf_dir)))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = derive(page_responses(spark.read.parquet(f"{sf_dir}/pages.parquet")), ["page_id"])
    return records.select("*", F.sha2("warc", 256).alias("record_sha256")).drop("warc")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("copies")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_url_filters, op2_language, op3_pii, op4_decontamination, op5_simhash, op6_warc, op7_quality, op8_mixing,
    op9_line_dedup, op10_sharding, op11_whitening, op12_collocations, op13_fingerprints)}

__all__ = ["ORACLE", "QUERIES"]
