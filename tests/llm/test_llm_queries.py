"""The registered queries against their SQL on the smallest tables, and the pipeline against brute force."""

import glob
import os
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from pagescan.llm.oracles import ORACLE
from pagescan.llm.queries import QUERIES
from tests.conftest import SF
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_text_operators import plain_containment


def value(x):
    if isinstance(x, float):
        return round(x, 6)
    return tuple(map(value, x)) if isinstance(x, list) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    cursor = connection.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})")
    assert Counter(tuple(map(value, r)) for r in frame.select(columns).collect()) == Counter(
        tuple(map(value, r)) for r in cursor.fetchall())


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_simhash_query(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(rows)
    prints = [plain_fingerprint(rows[i]) for i in ids]
    want = {i: (f"{p:016x}", ids[c]) for i, p, c in zip(ids, prints, plain_components(prints))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op5_simhash"](spark, SF).collect()} == want


def test_simhash_stage_is_the_operator(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    groups = {r.component_id for r in QUERIES["op5_simhash"](spark, SF).collect()}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()} == groups


def test_language_query_on_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = [r for r in QUERIES["op2_language"](spark, SF).collect() if r.held_out]
    assert len(got) > 20 and sum(lang[r.doc_id] == r.lang_pred for r in got) >= 0.95 * len(got)


def test_pipeline(spark):
    docs, kept, tables = spark.read.parquet(f"{SF}/documents.parquet"), {}, {}
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, SF).cache()
        tables[name] = [r.asDict() for r in docs.collect()]
        kept[name] = [r["doc_id"] for r in tables[name]]
        assert set(kept[name]) <= {r.doc_id for r in before.select("doc_id").collect()}
        if name != "shards":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(len(r["text"].split()) >= 1 for r in tables["quality_rules"])
    texts = {r["doc_id"]: r["text"] for r in tables["quality_rules"]}
    ids = sorted(texts)
    groups = defaultdict(list)
    for i, least in zip(ids, plain_components([plain_fingerprint(texts[i]) for i in ids])):
        groups[least].append(i)
    assert sorted(kept["near_duplicates"]) == sorted(min(g) for g in groups.values())
    clean = [i for i in kept["near_duplicates"] if not any(plain_containment(b, texts[i]) >= 0.8 for b in bench)]
    assert sorted(kept["decontamination"]) == sorted(clean)
    size = defaultdict(int)
    for r in tables["decontamination"]:
        size[r["source"]] += len(r["text"].split())
    taken = defaultdict(int)
    for r in tables["target_weights"]:
        taken[r["source"]] += len(r["text"].split())
    order = sorted(size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    longest = max(len(r["text"].split()) for r in tables["decontamination"])
    assert all(taken[s] <= 3 * size[s] for s in order)
    share = sum(size.values()) / sum(weight.values())
    assert all(abs(taken[s] - min(3 * size[s], share * weight[s])) <= longest + share for s in order)
    assert Counter(kept["shards"]) == Counter(kept["target_weights"])
    slots = defaultdict(list)
    for r in tables["shards"]:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r.doc_id, r.shard, r.slot) for r in corpus_pipeline.run(spark, SF).collect()) == Counter(
        (r["doc_id"], r["shard"], r["slot"]) for r in tables["shards"])


def test_stages_with_clashing_names(spark, clashing):
    body = " ".join(f"w{i}" for i in range(80))
    frame = clashing.selectExpr("doc_id", f"concat(coalesce(text, ''), ' {body} ', doc_id) AS text", "* EXCEPT (doc_id, text)").drop("n_chars")
    frame = frame.selectExpr(*frame.columns, "1 AS source_size", "2 AS text_crc32", "3 AS grown_shard", "4 AS n_chars", "5 AS root", "6 AS _nth", "7 AS _least", "8 AS _all")
    docs = frame
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "shards":
            assert out.columns == frame.columns, name
        docs = out.cache()
        assert docs.count() > 0, name
    row = docs.first()
    assert row.item_ids == frame.first().item_ids and row.law == "key" and row.root == 5
    results = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert docs.columns == [c for c in frame.columns if c not in results] + results


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_and_empty_tables(spark, odd, name, stage):
    assert stage(spark, odd, SF).count() <= 3 * odd.count()
    assert stage(spark, odd.limit(0), SF).count() == 0


def broken(spark):
    """Documents and pages one of which is no UTF-8."""
    rows = [(1, bytearray(b"good words \xff\xfe\xc3( and more of them, a@b.cc " * 20), "en", "a"), (2, bytearray("plain é words here ".encode() * 20), "de", "b"),
            (3, bytearray(b"\x80"), None, None)]
    return spark.createDataFrame(rows, "doc_id LONG, b BINARY, lang STRING, source STRING").selectExpr(
        "doc_id", "CAST(b AS STRING) AS text", "lang", "source", "CAST(length(b) AS LONG) AS n_chars",
        "doc_id AS page_id", "'http://a.com/' AS url", "CAST(b AS STRING) AS html")


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if n != "op11_whitening"])
def test_text_that_is_no_utf8_ends_no_query(spark, tmp_path, name):
    frame = broken(spark)
    frame.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    frame.select("page_id", "url", "html").write.parquet(str(tmp_path / "pages.parquet"))
    frame.selectExpr("doc_id AS item_id", "text").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = QUERIES[name](spark, str(tmp_path))
    found.write.format("noop").mode("overwrite").save()
    if "doc_id" in found.columns:
        assert found.select("doc_id").distinct().count() == 3


def test_pipeline_of_texts_that_are_no_utf8(spark, tmp_path):
    docs = broken(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs.write.format("noop").mode("overwrite").save()


def test_a_cluster_needs_a_shared_folder():
    from pagescan.llm.common import shared_folder

    class Context:
        master, folder = "spark://host:7077", None
        def getCheckpointDir(self): return self.folder
        def setCheckpointDir(self, folder): self.folder = folder

    class Conf:
        def get(self, key, default): return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())
    Session.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError):
        shared_folder(Session())
    for master in ("local", "local[*]", "local[4]", "local[2,3]"):
        Session.sparkContext.master, Session.sparkContext.folder = master, None
        assert shared_folder(Session())
