"""Files, targets, reports, roll-ups and streams."""

import json

import pytest
from pyspark.sql import functions as F

from pagescan import scan
from pagescan.operators import catalog as C
from pagescan.operators.ranking import numbered
from pagescan.operators.textrules import text_findings
from pagescan.plans.run import counters, scan_targets
from pagescan.sources import files as FS
from pagescan.sources import pages as P
from pagescan.sources import reports as S
from pagescan.sources.reporting import Reporter, write_report
from pagescan.streaming.scan import page_stream, scan_stream


@pytest.fixture
def site(tmp_path):
    root = tmp_path / "site"
    for name, content in {
            "a.html": b"<p style='display:none'>x</p>", "b.PHP": "<p>中文</p>".encode("gb18030"), "c.png": b"x", "d.js": b"\x00\x01",
            ".e.html": b"x", "one/two/three/f.css": b"a{display:none}", "one/two/three/four/g.css": b"x", ".git/h.html": b"x",
            "old/i.html": b"x", "j.html": b"", "k.txt": b"x", "l.min.js": b"x", "m.htm": b"caf\xe9 \xff\xfe",
            "n.html": b"\x01" * 400 + b"a" * 600}.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return str(root)


def names(df, site):
    return sorted(r.location.removeprefix(site + "/") for r in df.collect())


def test_directory_scan(spark, site):
    taken = FS.list_files(spark, site, exclude=["*.min.js", f"{site}/old/"])
    # Spark's file listing leaves out empty files (j.html).
    assert names(taken, site) == ["a.html", "b.PHP", "d.js", "m.htm", "n.html", "one/two/three/f.css"]
    assert names(FS.list_files(spark, site, "fast", depth=0), site) == ["a.html", "b.PHP", "m.htm", "n.html"]
    assert names(FS.file_pages(taken), site) == ["a.html", "b.PHP", "m.htm", "one/two/three/f.css"]
    decoded = {r.location[len(site) + 1:]: (r.charset, r.content) for r in FS.decode_files(taken).collect()}
    assert decoded["b.PHP"] == ("gb18030", "<p>中文</p>") and decoded["m.htm"][0] == "latin-1"
    empty = spark.createDataFrame([("/j.html", bytearray(b"")), ("/k.html", bytearray(b"x"))], "location STRING, content BINARY")
    assert [r.message for r in FS.file_errors(empty).collect()] == ["无法读取: /j.html"]
    rules = {r.location[len(site) + 1:] for r in scan(FS.file_pages(taken)).where("rule_id = 'hiding:display_none'").collect()}
    assert rules == {"a.html", "one/two/three/f.css"}


def test_directories_by_any_name(spark, tmp_path, monkeypatch):
    root = tmp_path / "in ner 中" / "a+b"
    root.mkdir(parents=True)
    (root / "x y%20.html").write_text("<p>")
    monkeypatch.chdir(tmp_path)
    for name in (str(tmp_path / "in ner 中"), f"file://{tmp_path}/in ner 中", f"file:{tmp_path}/in ner 中/"):
        assert [r.location for r in FS.list_files(spark, name).collect()] == [str(root / "x y%20.html")]


def test_selection_in_stores(spark):
    rows = [("s3a://bucket/dir/a.html", "s3a://bucket/dir"), ("hdfs://host:8020/dir/b/c.css", "hdfs://host:8020/dir/"),
            ("s3a://other/dir/a.html", "s3a://bucket/dir"), ("s3a://bucket/dir/.x/a.html", "s3a://bucket/dir")]
    got = [spark.sql(f"SELECT {FS.selected(repr(path), base)} AS s").first().s for path, base in rows]
    assert got == [True, True, False, False]
    assert spark.sql(f"SELECT {FS.location(repr('s3a://b/x%20y+z.html'))} AS l").first().l == "s3a://b/x y+z.html"


def test_targets(spark, tmp_path):
    (tmp_path / "t.txt").write_text("http://10.0.0.1/x\n\n  https://a.com:80/y \nhttps://172.32.0.1/\n/x/y.html\n/x/y\n", "utf-8")
    rows = P.classify_targets(P.read_targets(spark, str(tmp_path / "t.txt"))).collect()
    assert [tuple(r) for r in rows] == [
        ("http://10.0.0.1/x", "internal_url"), ("https://a.com:80/y", "external_url"), ("https://172.32.0.1/", "external_url"),
        ("/x/y.html", "local_file"), ("/x/y", "local_directory")]
    with pytest.raises(ValueError):
        P.extensions("other")


def test_first_of_location_with_a_hot_location(spark):
    rows = spark.range(3000).selectExpr(
        "id AS page_id", "IF(id % 3 = 0, 'hot', concat('u', id)) AS location", "concat('c', id) AS content")
    kept = P.first_of_location(rows)
    assert kept.count() == 2001 and kept.where("location = 'hot'").first().content == "c0"


def test_numbers_are_gapless_and_ordered_even_with_copies(spark):
    rows = spark.range(5000).selectExpr("IF(id % 3 = 0, 'big', concat('g', id % 7)) AS g",
                                        "IF(id % 2 = 0, 1, CAST(id AS INT)) AS v").repartition(6)
    result = numbered(rows, "g", "v").collect()
    groups = {}
    for r in result:
        groups.setdefault(r.g, []).append((r.no, r.v))
    assert len(result) == 5000
    for members in groups.values():
        members.sort()
        assert [no for no, _ in members] == list(range(1, len(members) + 1))
        assert [v for _, v in members] == sorted(v for _, v in members)
    assert sorted(r.no for r in numbered(rows, None, "v").collect()) == list(range(1, 5001))


def test_report_files(spark, pages, tmp_path):
    found = text_findings(pages("=1+1 display:none 赌", "https://evil.xyz/ 赌博 登录"), [*C.HIDING, C.URL])
    S.write_csv(found, str(tmp_path / "csv"))
    rows = spark.read.csv(str(tmp_path / "csv"), header=True).collect()
    assert [r["序号"] for r in sorted(rows, key=lambda r: int(r["序号"]))] == [str(i + 1) for i in range(found.count())]
    assert any(r["上下文"].startswith("'=1+1") for r in rows)
    S.write_json(found, str(tmp_path / "json"), target="t", mode="deep")
    summary = json.loads("".join(p.read_text() for p in (tmp_path / "json" / "summary").glob("*.json")))
    assert summary["report"]["mode"] == "deep" and summary["statistics"]["total_findings"] == found.count()
    assert spark.read.json(str(tmp_path / "json" / "findings")).count() == found.count()
    S.write_text(found, str(tmp_path / "text"))
    assert any("[1] https://evil.xyz/" in r.value for r in spark.read.text(str(tmp_path / "text")).collect())


def test_stream_equals_batch(spark, pages, tmp_path):
    table = pages("<p style='display:none'>赌博</p>", "https://evil.xyz/ eval(1)", "plain")
    table.write.parquet(str(tmp_path / "in"))
    query = scan_stream(page_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "state"), once=True)
    assert query.awaitTermination(120)

    def rows(df):
        return sorted((r.page_id, r.rule_id, r.evidence, r.pos_start) for r in df.collect())

    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(scan(table))


def test_numbering_runs_nothing_ahead_and_reads_its_input_once(spark, tmp_path, capsys):
    spark.range(20_000).selectExpr("IF(id % 3 > 0, 'big', concat('g', id % 7)) AS g", "id % 50 AS v", "concat('e', id) AS e").repartition(4).write.parquet(
        str(tmp_path / "rows"))
    written = spark.read.parquet(str(tmp_path / "rows"))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None) or [])
    frame = numbered(written, "g", "-v", "e")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None) or []) == jobs
    rows = frame.collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.g, []).append((r.no, -r.v, r.e))
    for members in groups.values():
        members.sort()
        assert [n for n, *_ in members] == list(range(1, len(members) + 1)) and [m[1:] for m in members] == sorted(m[1:] for m in members)
    frame.explain("formatted")
    plan = capsys.readouterr().out
    assert "ResolvedHint" not in plan and "Checkpoint" not in plan and "Scan ExistingRDD" not in plan


def test_reports_evaluate_a_scan_once(spark, pages):
    found = scan(pages("<p style='display:none'>赌博</p> https://evil.xyz/ eval(1)"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for report in (S.csv_rows, S.text_rows, S.section_rows):
            assert report(found)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1, report
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_large_group_is_numbered_in_many_tasks(spark):
    from pagescan.operators import ranking
    rows = spark.range(30_000).selectExpr("'all' AS g", "id AS v")
    with_range = rows.withColumn("_copies", F.lit(1)).withColumn("_key", ranking._key("g", ["v"]))
    sample = with_range.select("_key", F.xxhash64("_key").alias("h")).orderBy("h").limit(ranking.SAMPLE)
    bounds = sorted(tuple(r._key) for r in sample.collect())
    assert len(bounds) == ranking.SAMPLE and numbered(rows, "g", "v").where("no != v + 1").count() == 0


def test_range_of_a_key_is_found_by_halving(spark, rng=None):
    from pagescan.operators.ranking import _range_of
    import random
    rng = random.Random(1)
    for _ in range(30):
        bounds = sorted(rng.randrange(60) for _ in range(rng.randrange(255)))
        keys = [rng.randrange(-5, 70) for _ in range(20)]
        frame = spark.createDataFrame([(bounds, k) for k in keys], "b ARRAY<INT>, k INT")
        assert [r.n for r in frame.selectExpr(f"{_range_of('b', 'k')} AS n").collect()] == [sum(x < k for x in bounds) for k in keys]


class Headlines(Reporter):
    """A user's own report: one line for each rule."""

    ending, header = ".lst", "# rules"

    def lines(self, findings):
        return findings.groupBy("rule_id").count().selectExpr("rule_id AS no", "concat(rule_id, ' ', count) AS line")


def test_reporters(spark, pages, tmp_path):
    found = text_findings(pages(*["display:none \"q\", opacity:0;\nvisibility:hidden"] * 30, "-1 赌博 \r\n https://a.xyz/"), [*C.HIDING, C.URL])
    write_report(found, str(tmp_path / "own"), Headlines())
    lines = [r.value for r in spark.read.text(str(tmp_path / "own")).collect()]
    assert "# rules" in lines and "hiding:display_none 30" in lines
    assert {p.suffix for p in (tmp_path / "own").iterdir() if p.is_file() and not p.name.startswith(".")} == {".lst"}
    write_report(found.limit(0), str(tmp_path / "own"), Headlines())
    assert [p.name for p in (tmp_path / "own").iterdir()] == []
    S.write_csv(found, f"file:{tmp_path}/csv")
    rows = spark.read.csv(str(tmp_path / "csv"), header=True, multiLine=True, escape='"').collect()
    assert len(rows) == found.count() and (tmp_path / "csv").exists()
    assert next(iter((tmp_path / "csv").glob("part-*.csv"))).read_bytes().startswith(b"\xef\xbb\xbf")


def test_a_failed_task_leaves_no_report(spark, pages, tmp_path):
    class Broken(Headlines):
        def lines(self, findings):
            return findings.repartition(3).selectExpr("pos_start AS no", "IF(evidence LIKE '%7%', raise_error('no'), evidence) AS line")

    found = text_findings(pages(*[f"https://h{i}.xyz/" for i in range(9)]), [C.URL])
    write_report(found, str(tmp_path / "out"), Headlines())
    before = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()}
    with pytest.raises(Exception):
        write_report(found, str(tmp_path / "out"), Broken())
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == before


def test_one_call_from_targets_to_a_run(spark, tmp_path):
    fetched = spark.createDataFrame([("http://a.com/", "<p style='display:none'>x</p> http://q.bid:99999/e"), ("https://b.com/", None),
                                     ("http://not.asked/", "display:none")], "url STRING, html STRING")
    files = spark.createDataFrame([("/site/x/a.html", bytearray(b"display:none")), ("/site/x/b.html", bytearray(b"")),
                                   ("/other/c.html", bytearray(b"display:none")), ("/site/d.html", bytearray(b"opacity:0;"))], "location STRING, content BINARY")
    targets = spark.createDataFrame([("http://a.com/",), ("https://b.com/",), ("http://c.com/",), ("/site/",), ("/site/x/a.html",), ("http://a.com/",)], "target STRING")
    run = scan_targets(targets, fetched, files, str(tmp_path / "run"))
    assert {r.location for r in run.findings.where("rule_id LIKE 'hiding:%'").collect()} == {"http://a.com/", "/site/x/a.html", "/site/d.html"}
    assert sorted((r.location, r.stage) for r in run.errors.collect()) == [
        ("/site/x/b.html", "read"), ("http://a.com/", "url"), ("http://c.com/", "fetch"), ("https://b.com/", "fetch")]
    assert counters(run).first().asDict() == {"scanned_files": 2, "scanned_urls": 3, "total_scanned": 5, "errors": 4}
    assert run.verdict().first().risk in ("critical", "high") and run.summary().count() > 0
    empty = scan_targets(targets.limit(0), fetched, None, str(tmp_path / "none"))
    assert empty.findings.count() == 0 and empty.counters["total_scanned"] == 0


def test_first_of_location_on_a_stream(spark, tmp_path):
    from pagescan.streaming.first import first_of_location_stream
    folder, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))

    def arrive(*rows):
        spark.createDataFrame(rows, "page_id LONG, location STRING, content STRING, t STRING").selectExpr(
            "page_id", "location", "content", "CAST(t AS TIMESTAMP) AS seen_at").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("page_id LONG, location STRING, content STRING, seen_at TIMESTAMP").parquet(folder)
        first = first_of_location_stream(stream, "seen_at", late="10 minutes", expire="1 hour")
        query = first.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(out)
        assert query.awaitTermination(120)
        return sorted((r.location or "-", r.page_id, r.content) for r in spark.read.schema("page_id LONG, location STRING, content STRING").parquet(out).collect())

    assert arrive((3, "a", "x", "2024-01-01 10:00:00"), (1, "a", "y", "2024-01-01 10:00:00"), (2, "b", "z", "2024-01-01 10:00:00"),
                  (9, None, "n", "2024-01-01 10:00:00")) == [("-", 9, "n"), ("a", 1, "y"), ("b", 2, "z")]
    # A restarted stream, a copy within the time, and a new location.
    assert len(arrive((4, "a", "again", "2024-01-01 10:30:00"), (5, "c", "new", "2024-01-01 10:30:00"), (6, None, "m", "2024-01-01 10:30:00"))) == 4
    # Later than the watermark allows: not scanned.
    assert len(arrive((7, "d", "late", "2024-01-01 09:00:00"))) == 4
    # The watermark moves far on, and in the batch after that the states end.
    arrive((8, "e", "far", "2024-01-01 15:00:00"))
    rows = arrive((10, "a", "back", "2024-01-01 15:01:00"))
    assert ("a", 10, "back") in rows and len(rows) == 6


def test_cloaking_with_one_hot_location(spark):
    from pagescan.operators.rendered import cloaked_findings
    rows = spark.range(2000).selectExpr("IF(id % 2 = 0, 'hot', CAST(NULL AS STRING)) AS location", "'r' AS rule_id", "IF(id % 500 < 2, 'rare', 'same') AS evidence", "id")
    other = rows.where("evidence = 'same' OR location = 'hot'")
    left = cloaked_findings(rows, other).collect()
    assert {(r.location, r.evidence) for r in left} == {(None, "rare")} and len(left) == 4
    assert cloaked_findings(rows, rows.limit(0)).count() == 2000
