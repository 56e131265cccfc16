"""Scanning pages as they arrive.

Every rule is stateless per page, so the batch functions run on a stream as they are: no
watermark, no state, append mode.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagescan.plans.scan import scan
from pagescan.schema import PAGES


def page_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder of pages(page_id, location, content)."""
    reader = spark.readStream.schema(PAGES)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def scan_stream(pages: DataFrame, sink: str, checkpoint: str, mode: str = "deep", once: bool = False,
                **options) -> StreamingQuery:
    """Append the findings of each batch of pages to a Parquet folder."""
    writer = (scan(pages, mode, **options).writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint))
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(sink)
