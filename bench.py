"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local threads.
"""

import json
import os
import tempfile
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from oracle.corpus import seeded_pages
from oracle.queries import QUERIES, SAMPLE_RULES
from pagescan.operators import catalog as C
from pagescan.operators import rollups
from pagescan.operators.dom import dom_findings
from pagescan.operators.textrules import entropy_findings, extract_urls, text_findings
from pagescan.plans.scan import detect, scan
from pagescan.rules.loaders import custom_rules, keyword_table

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session() -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("pagescan-bench")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", CPUS)
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    spark = session()
    # Written as a table of many files is, and read again by every job.
    folder = f"{tempfile.mkdtemp(prefix='pagescan-bench-')}/pages"
    seeded_pages(spark, SF_DIR).repartition(2 * int(CPUS)).write.parquet(folder)
    pages = spark.read.parquet(folder)
    count, many = pages.count(), reduce(DataFrame.unionAll, [pages] * 10)

    many_words = keyword_table([(f"word{i}x", "other", 5) for i in range(50_000)])

    def planned():
        begin = time.perf_counter()
        scan(pages)._jdf.queryExecution().executedPlan()
        return time.perf_counter() - begin

    jobs = {
        "scan_deep": lambda: scan(pages),
        "scan_deep_x10": lambda: scan(many),
        "scan_fast": lambda: scan(pages, "fast"),
        "keyword": lambda: detect(pages, "keyword"),
        "html": lambda: detect(pages, "html"),
        "js": lambda: detect(pages, "js"),
        "css": lambda: detect(pages, "css"),
        "hiding": lambda: detect(pages, "hiding"),
        "elements": lambda: dom_findings(pages),
        "entropy": lambda: entropy_findings(pages),
        "extract_urls": lambda: extract_urls(pages),
        "user_rules": lambda: scan(pages, "fast", rules=custom_rules([r for r, *_ in SAMPLE_RULES])),
        "keywords_50k": lambda: text_findings(pages, [C.KEYWORD], many_words),
        "page_verdicts": lambda: rollups.page_verdicts(pages, scan(pages)),
        "report_sections": lambda: QUERIES["snk5_report_sections"](spark, SF_DIR),
        "entropy_documents": lambda: QUERIES["js19_entropy_documents"](spark, SF_DIR),
    }
    scan(pages).write.format("noop").mode("overwrite").save()  # start workers, compile
    times = {}
    for name, job in jobs.items():
        begin = time.perf_counter()
        job().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    times["plan_scan"] = round(min(planned() for _ in range(3)), 3)
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1], "pages": count,
        "pages_per_sec": round(9 * count / max(times["scan_deep_x10"] - times["scan_deep"], 0.001), 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
