"""URL rules by a sort-merge range join on reversed-host keys.

A rule is a host and the beginning of a path.  Its canonical key is the host with its labels
reversed, a slash, and the path; the keys that begin with it are an interval, and two such
intervals are nested or apart.  A URL is looked up once for each host suffix a rule can have,
by the key of that suffix and as much of its path as a rule can look at.  Rule beginnings,
rule ends and look-ups are sorted together.  A sweep over them keeps the stack of rules that
are open: a beginning pushes, an end uncovers the rule around it, so the top after each event
is the event's own rule or that rule's parent, and the last top before a look-up is its answer.

The sweep is range-partitioned; what is open at the start of a partition is carried over from
the last event of those before it.  Only distinct look-ups are swept.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagescan.llm.common import kept, small

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), *_LOWER), F.lit(""))


def path_of(url) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty where there is no host."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(labels, path) -> Column:
    """Bytes of the reversed host, a slash, and the path; UTF-8 sorts by code point and never holds FF."""
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("/"), path).cast("binary")


def clean_rules(rules: DataFrame) -> DataFrame:
    """Usable rules, one for each host and path: ``rule, verdict, key, labels, path_length``.

    Rows with a NULL in host, path or verdict or with an empty host are left out; hosts are
    lower-cased; of two verdicts for one rule the lesser word holds, which lets allow win.
    """
    host = F.translate(F.col("host"), *_LOWER)
    return (rules.where("host != '' AND path IS NOT NULL AND verdict IS NOT NULL")
            .groupBy(host.alias("host"), "path").agg(F.min("verdict").alias("verdict"))
            .select(F.concat("host", "path").alias("rule"), "verdict", _key(F.split("host", r"\."), F.col("path")).alias("key"),
                    F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_length")))


def _events(rules: DataFrame) -> DataFrame:
    """Beginnings and ends of rules as ``key, top``: the rule on top of the stack from there on.

    A rule's parent is the longest other rule whose key begins its own; its candidates are the
    beginnings of its path (hosts of rules on one stack are equal), so no rules are paired up.
    """
    host_length = F.expr("octet_length(substring_index(CAST(key AS STRING), '/', 1)) + 1")
    ahead = rules.select(F.col("key").alias("child"), F.explode(F.sequence(host_length, F.octet_length("key"))).alias("n")) \
        .where(F.col("n") < F.octet_length("child"))
    parents = ahead.select("child", "n", F.expr("substring(child, 1, n)").alias("_key")).join(
        rules.select(F.col("key").alias("_key"), F.struct("rule", "verdict").alias("parent")), "_key").groupBy("child").agg(
        F.max_by("parent", "n").alias("parent"))
    both = rules.join(parents, F.col("key") == F.col("child"), "left")
    begin = both.select("key", F.struct("rule", "verdict").alias("top"))
    end = both.select(F.concat("key", F.lit(bytearray(b"\xff"))).alias("key"), F.col("parent").alias("top"))
    return begin.unionByName(end).select("key", F.lit(0).alias("kind"), F.struct("top").alias("event"))


def sweep(lookups: DataFrame, rules: DataFrame) -> DataFrame:
    """``key, top`` for distinct ``lookups(key)``: the innermost rule whose interval holds the key, or NULL."""
    events = _events(rules).unionByName(lookups.select("key", F.lit(1).alias("kind"), F.lit(None).cast(
        "struct<top:struct<rule:string,verdict:string>>").alias("event")))
    dealt = kept(events.repartitionByRange("key", "kind").withColumn("part", F.spark_partition_id()))
    # The stack's top after each partition, and so before the next.
    last = dealt.where("kind = 0").groupBy("part").agg(F.max_by("event", "key").alias("event"))
    parts = dealt.select("part").distinct().join(last, "part", "left")
    carry = parts.select("part", F.last("event", ignorenulls=True).over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    so_far = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return dealt.withColumn("seen", F.last("event", ignorenulls=True).over(so_far)).where("kind = 1").join(
        small(kept(carry)), "part").select("key", F.coalesce("seen", "carried")["top"].alias("top"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", keep=("page_id",)) -> DataFrame:
    """``keep``, ``host``, ``path``, ``rule``, ``verdict``: a row for each row of ``pages(url)``.

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains where the URL's path
    begins with the rule's; of several the longest (host and path together, then the longer host) gives the verdict,
    else ``default`` does and rule is NULL.  A NULL URL or one without ``://`` has empty host and path
    and fits no rule.  Without rules everything has the default.  ``keep`` must not name results;
    other columns are not read.
    """
    rules = kept(clean_rules(rules))
    longest, counts = rules.agg(F.coalesce(F.max("path_length"), F.lit(0)), F.collect_set("labels")).first()
    rows = pages.select(*keep, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not counts:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    # Labels beyond the longest rule's and paths beyond the longest path decide nothing.
    most = max(counts)
    rows = rows.withColumns({"_host": F.substring_index("host", ".", -most), "_path": F.substring("path", 1, longest)})
    distinct = kept(rows.select("_host", "_path").where("_host != ''").distinct())
    labels = F.split("_host", r"\.")
    asked = distinct.select("_host", "_path", F.explode(F.array(*map(F.lit, sorted(counts)))).alias("n")).where(
        F.size(labels) >= F.col("n")).select("_host", "_path", _key(F.expr(
            "slice(split(_host, '[.]'), -n, n)"), F.col("_path")).alias("key"))
    found = sweep(asked.select("key").distinct(), rules)
    best = kept(asked.join(found.where("top IS NOT NULL"), "key").groupBy("_host", "_path").agg(
        F.max_by("top", F.struct(F.length(F.col("top.rule")), F.length(F.regexp_replace("top.rule", "(?s)/.*", "")))).alias("top")))
    return rows.join(small(best), ["_host", "_path"], "left").select(
        *keep, "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))
