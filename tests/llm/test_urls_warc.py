"""URL rules and WARC derivatives against brute force."""

import hashlib
import re

from pyspark.sql import functions as F

from pagescan.llm import url_filters, warc

RULES = "host STRING, path STRING, verdict STRING"


def plain_judge(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules
            if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def judged(spark, urls, rules, **more):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id BIGINT, url STRING").repartition(3)
    out = url_filters.judge_urls(pages, spark.createDataFrame(rules, RULES), **more)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}


def test_random_rules_and_urls(spark, rng):
    label, letter = ["a", "b", "com", "x.y", "é", "a-b"], ["/", "a", "b", "/a", "é", "\U0010ffff", "%"]
    rules = {(".".join(rng.choice(label) for _ in range(rng.randrange(1, 4))),
              "".join(["/"][:rng.randrange(2)] + [rng.choice(letter) for _ in range(rng.randrange(4))])): rng.choice(["allow", "block"])
             for _ in range(200)}
    rules = [(h, p, v) for (h, p), v in rules.items() if not p or p[0] == "/"]
    urls = [rng.choice(["http", "", "HTTPS"]) + rng.choice(["://", "://", "://", ":/", "//"])
            + ".".join(rng.choice(label + ["A", "COM", ""]) for _ in range(rng.randrange(5)))
            + rng.choice(["", "/"]) + "".join(rng.choice(letter) for _ in range(rng.randrange(6))) + rng.choice(["", "?q=/a", "#f", "?u=http://b/"])
            for _ in range(1500)]
    got = judged(spark, urls, rules)
    for i, url in enumerate(urls):
        assert got[i] == plain_judge(url, rules), url


def test_sweep_over_many_partitions(spark, rng):
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rules = [("com", "/", "block"), ("com", "/m", "allow"), ("a.com", "/", "allow"), ("z.com", "/zz", "allow")]
        urls = [f"http://{rng.choice('abz')}.com/{rng.choice('amz')}{i}" for i in range(500)]
        got = judged(spark, urls, rules)
        assert all(got[i] == plain_judge(u, rules) for i, u in enumerate(urls))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_odd_urls_and_rules(spark, clashing):
    urls = [None, "", "no scheme", "http://", "http:///p", "x://H?q", "http://a.b/c\nd", "http://" + "a." * 3000 + "com/" + "p" * 9000]
    rules = [(None, "/", "block"), ("com", None, "block"), ("", "/", "block"), ("b", "/c", "block"), ("b", "/c", "allow"), ("COM", "/p", "block")]
    got = judged(spark, urls, rules, default="unknown")
    assert [got[i][0] for i in range(6)] == ["", "", "", "", "", "h"] and got[4][1] == "/p"
    assert {got[i][3] for i in range(6)} == {"unknown"} and got[6][1:] == ("/c\nd", "b/c", "allow") and got[7][2] == "com/p"
    assert judged(spark, urls[5:7], [])[1][2:] == (None, "allow")
    pages = clashing.select("*", F.lit("http://a.com/").alias("url"))
    rules = spark.createDataFrame([("com", "/", "block")], RULES)
    assert url_filters.judge_urls(pages, rules, keep=["doc_id"]).where("verdict = 'block'").count() == 3
    assert url_filters.judge_urls(pages.limit(0), rules, keep=["doc_id"]).count() == 0


def parsed(record):
    head, _, rest = record.partition("\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
    return fields, rest.encode()[:int(fields["Content-Length"])].decode(), rest.encode()[int(fields["Content-Length"]):]


def test_derivatives_are_linked_and_digests_hold(spark):
    pages = spark.createDataFrame([(1, "http://a/é", "<html><head><title>T</title><style>x{</style></head><body><p>one&amp;two"
                                    "<!-- no --><script>1<2</script><br>thrée</p></body>"), (2, None, None), (3, "http://b/", "")],
                                  "page_id BIGINT, url STRING, html STRING")
    responses = warc.page_responses(pages)
    source = {r.page_id: parsed(r.warc) for r in responses.collect()}
    rows = warc.derive(responses, ["page_id"]).collect()
    assert sorted((r.page_id, r.record_type) for r in rows) == [(i, t) for i in (1, 2, 3) for t in ("conversion", "metadata")]
    for r in rows:
        fields, block, end = parsed(r.warc)
        assert end == b"\r\n\r\n" and fields["WARC-Refers-To"] == source[r.page_id][0]["WARC-Record-ID"] == r.refers_to
        assert fields["WARC-Block-Digest"] == r.block_digest == "sha256:" + hashlib.sha256(block.encode()).hexdigest()
        assert r.source_digest == source[r.page_id][0]["WARC-Payload-Digest"]
    meta = {r.page_id: r for r in rows if r.record_type == "metadata"}
    text = {r.page_id: r for r in rows if r.record_type == "conversion"}
    assert all(meta[i].concurrent_to == text[i].record_id for i in meta)
    assert parsed(text[1].warc)[1] == "T\none&two\nthrée" and parsed(text[2].warc)[1] == ""
    block = parsed(meta[1].warc)[1]
    assert "source-header: Content-Type: text/html; charset=UTF-8\r\n" in block and "source-status: HTTP/1.1 200 OK" in block


def test_other_records(spark, clashing):
    response = ("WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n")
    plain, image = "HTTP/1.1 200 OK\r\ncontent-type: text/plain\r\n\r\na <b>\r\n\r\nc", "HTTP/1.1 404 No\r\nContent-Type: image/png\r\n\r\nzz"
    rows = [(1, response.format(len(plain), plain)), (2, response.format(len(image), image)), (3, response.format(5, "<p>ab")),
            (4, "WARC/1.0\r\nWARC-Type: request\r\nWARC-Record-ID: <urn:y>\r\n\r\nGET"), (5, None), (6, ""), (7, "junk"),
            (8, "WARC/1.0\r\nWARC-Type: response\r\n\r\nno id")]
    got = {}
    for r in warc.derive(spark.createDataFrame(rows, "doc_id BIGINT, warc STRING"), ["doc_id"]).collect():
        got.setdefault(r.doc_id, {})[r.record_type] = parsed(r.warc)[1]
    assert set(got) == {1, 2, 3} and got[1]["conversion"] == "a <b>\r\n\r\nc" and set(got[2]) == {"metadata"}
    assert got[3]["conversion"] == "<p>ab".replace("<p>", "") and "404" in got[2]["metadata"]
    wide = clashing.withColumns({n: F.lit(i) for i, n in enumerate(["id", "uri", "http", "head", "block", "bytes", "_keep"])})
    got = warc.derive(wide.withColumn("warc", F.lit(rows[0][1])), ["doc_id", "id", "_keep", "head"])
    assert got.columns[:4] == ["doc_id", "id", "_keep", "head"] and got.where("_keep = 6").count() == 6


def test_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>page {i}\r\n\r\nmore") for i in range(20)], "page_id BIGINT, url STRING, html STRING")
    made = warc.derive(warc.page_responses(pages))
    warc.write_warc(made, str(tmp_path / "out"))
    assert sorted(r.warc for r in warc.read_warc(spark, str(tmp_path / "out")).collect()) == sorted(r.warc for r in made.collect())


def test_blocks_that_hold_the_end_of_a_record(spark, tmp_path):
    """Pages about the format itself, one of them with whole records in it, and with a wrong length inside."""
    inner = "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nContent-Length: 999999\r\n\r\nx\r\n\r\nWARC/1."
    bodies = ["<p>a\r\n\r\nWARC/1.0 is the first line\r\n\r\nWARC/1.1</p>", "plain", f"<pre>{inner}\r\n\r\n</pre>", "", "\r\n\r\nWARC/1.", "end\r\n\r\n"]
    pages = spark.createDataFrame([(i, f"http://a/{i}", b) for i, b in enumerate(bodies * 5)], "page_id BIGINT, url STRING, html STRING")
    made = warc.page_responses(pages)
    for kind in ("gzip", "none"):
        path = str(tmp_path / kind)
        warc.write_warc(made.coalesce(2), path, kind)
        back = warc.read_warc(spark, path)
        assert sorted(r.warc for r in back.collect()) == sorted(r.warc for r in made.collect())
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        try:
            assert sorted(r.warc for r in warc.read_warc(spark, path).collect()) == sorted(r.warc for r in made.collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        derived = warc.derive(back).where("record_type = 'conversion'")
        assert sorted(r.warc for r in derived.collect()) == sorted(r.warc for r in warc.derive(made).where("record_type = 'conversion'").collect())


def test_blocks_that_are_no_text(spark, tmp_path):
    body = bytes(range(256)) * 3 + b"\r\n\r\nWARC/1.0\r\n"
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    short = b"WARC/1.0\r\nWARC-Type: metadata\r\n\r\nno length\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record + short + record)
    (tmp_path / "empty.warc").write_bytes(b"")
    got = [bytes(r.b) for r in warc.read_warc(spark, str(tmp_path)).selectExpr("CAST(warc AS BINARY) AS b").collect()]
    assert sorted(got) == sorted([record, short, record])


def test_character_references(spark):
    import html
    texts = ["&#8217;&#xE9;&eacute;&mdash;&amp;lt; &lt;&#60;&#x3c; &unknown; &amp &; &#; &#x; &AMP;&nbsp;&NotEqualTilde;", "&#128;&#153;&#129;&#0;&#xD800;&#x110000;",
             "no reference", "a & b", "&am&#112;;lt;", "&copy;&middot;" * 50]
    frame = spark.createDataFrame(list(enumerate(texts)), "page_id BIGINT, html STRING")
    got = {r.page_id: r.t for r in frame.select("page_id", warc.resolved(F.col("html")).alias("t")).collect()}
    # The library function also takes names without a semicolon, so those are kept out of its sight.
    for i in (0, 2, 3, 5):
        assert got[i] == html.unescape(texts[i].replace("&amp &;", "@")).replace("@", "&amp &;"), texts[i]
    assert got[1] == "€™\x81\ufffd\ufffd\ufffd" and got[4] == "&amp;lt;"


def test_open_ended_pages_are_linear(spark):
    import time
    hostile = ["<!--" * 100_000, "<script>" * 60_000, "<p" * 200_000, "<" * 300_000, " \n" * 200_000, "<style" * 50_000]
    frame = spark.createDataFrame(list(enumerate(hostile)), "page_id BIGINT, html STRING")
    begin = time.time()
    assert frame.select(F.sum(F.length(warc.html_text(F.col("html"))))).first()[0] >= 0
    assert time.time() - begin < 60


def test_blanks_of_a_page_are_joined(spark):
    import random
    import re
    from pagescan.llm.warc import html_text
    rng = random.Random(5)
    texts = ["".join(rng.choice(" \n\t\r\f\x0bab") for _ in range(rng.randrange(40))) for _ in range(2_000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING").select("i", html_text("t").alias("got")).collect()
    for r in rows:
        assert r.got == re.sub(r"[ \n]*\n[ \n]*", "\n", re.sub(r"[ \t\r\f\x0b]+", " ", texts[r.i])).strip(" \n"), texts[r.i]
