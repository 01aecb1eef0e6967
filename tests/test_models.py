"""Operators with models, on scripted replies."""

import json

import pytest
from pyspark.sql import functions as F

from quire.config import IndexingConfig
from quire.errors import ChatParseFailed
from quire.functions.json_clean import parse, schema_hint, snake_key
from quire.models.chat import HttpModel, RuleModel, ScriptedModel, structured
from quire.models.prompts import PROMPTS, render
from quire.operators import answer, with_model
from quire.operators.store import PatternCache, TreeStore


def test_structured_retries_once():
    model = ScriptedModel({"t": ["no json", '{"someKey": 1}']})
    assert structured(model, [("user", "q")], "{}", tags=["t"]) == {"some_key": 1}
    assert [m[0] for m in model.calls[1][0]] == ["system", "user", "assistant", "user"]
    with pytest.raises(ChatParseFailed):
        structured(ScriptedModel({"t": ["```json\n{}\n```"]}), [("user", "q")], "{}", tags=["t"])


def test_http_joins_system_messages():
    url, _, body = HttpModel("anthropic", "k", "m", "http://x").request([("system", "a"), ("system", "b"), ("user", "q")])
    assert url == "http://x/messages" and body["system"] == "a\n\nb" and len(body["messages"]) == 1


def test_json():
    assert parse('```json\n{"aB": [1, None,],}\n```') == {"a_b": [1, None]}
    assert parse("bad") is None and parse("[1]", dict) is None
    assert snake_key("HTMLParser") == "html_parser"
    assert json.loads(schema_hint(answer.QA)) == {"answer": "string", "reasoning": "string"}


def test_prompts():
    assert len(PROMPTS) == 16
    with pytest.raises(KeyError):
        render("none")


def test_cache_is_lru():
    cache = PatternCache(2)
    cache.put("a", [1])
    cache.put("b", [])
    assert cache.get("a") == [1]
    cache.put("c", [3])
    assert cache.get("b") is None and cache.get("a") == [1]


def _outline(messages, tags):
    import re

    numbers = re.findall(r"<physical_index_(\d+)>", messages[-1][1])
    if "toc-detection" in tags:
        return json.dumps({"toc_detected": "yes" if "LIST" in messages[-1][1] else "no"})
    if "toc-extraction" in tags:
        return "A\nB"
    if "toc-transform" in tags:
        return json.dumps({"table_of_contents": [{"structure": "1", "title": "A"}, {"structure": "1.1", "title": "B"}]})
    if "toc-page-matching" in tags:
        return json.dumps([{"structure": "1", "title": "A", "physical_index": "<physical_index_2>"}, {"structure": "1.1", "title": "B", "physical_index": None}])
    if "regex-discovery" in tags:
        return json.dumps([{"regex": "^S (.)$", "level": 1}])
    return json.dumps([{"structure": None, "title": f"T{n}", "physical_index": f"<physical_index_{n}>"} for n in dict.fromkeys(numbers)])


def test_model_detectors(spark):
    rows = spark.createDataFrame([("d", 1, "LIST"), ("d", 2, "x" * 40), ("d", 3, "y" * 40)], "document_id string, page_number int, text string")
    model = RuleModel(_outline)
    got = with_model.by_unnumbered_contents(model)(rows, IndexingConfig()).orderBy("entry_pos").collect()
    assert [(r.title, r.physical_index, r.level) for r in got] == [("A", 2, 1), ("B", None, 2)]
    got = with_model.by_outline(model)(rows, IndexingConfig(page_group_max_tokens=11)).orderBy("entry_pos").collect()
    assert [(r.title, r.physical_index) for r in got] == [("T1", 1), ("T2", 2), ("T3", 3)]
    lines = spark.createDataFrame([("d", 1, "S a\n1\n2\nS b\n3\nS c\n4")], "document_id string, page_number int, text string")
    cache = PatternCache()
    got = with_model.by_discovered_patterns(model, cache)(lines, IndexingConfig()).orderBy("entry_pos").collect()
    assert [r.title for r in got] == ["a", "b", "c"] and list(cache.held.values()) == [[("^S (.)$", 1)]]


def test_failed_model_leaves_the_document(spark):
    def broken(messages, tags):
        raise RuntimeError

    rows = spark.createDataFrame([("d", 1, "x")], "document_id string, page_number int, text string")
    assert with_model.by_outline(RuleModel(broken))(rows, IndexingConfig()).count() == 0


def test_judge(spark):
    rows = spark.createDataFrame([("q", "e", "a"), ("q", "e", None)], "question string, expected_answer string, actual string")
    got = answer.judge(rows, RuleModel(_judge)).collect()
    assert sorted(r.score for r in got) == ["ERROR", "PARTIALLY_CORRECT"]


def _judge(messages, tags):
    return 'Well: {"score": "partially_correct", "reasoning": "r"}'


def test_store_and_stream(spark, tmp_path):
    from quire.streaming import index_pages

    store = TreeStore(spark, str(tmp_path / "trees"), buckets=4)
    store.save(spark.createDataFrame([("a", 1), ("b", 1)], "document_id string, v int"))
    store.save(spark.createDataFrame([("a", 2)], "document_id string, v int"))
    assert sorted(tuple(r) for r in store.all().select("document_id", "v").collect()) == [("a", 2), ("b", 1)]
    assert store.find("a").first().v == 2
    store.delete("a")
    assert store.find("a").count() == 0
    pages = spark.createDataFrame([("x", 1, "# A\n# B\n# C"), ("y", 1, "plain")], "document_id string, page_number int, text string")
    pages.write.parquet(str(tmp_path / "pages"))
    trees = TreeStore(spark, str(tmp_path / "built"), buckets=4)
    index_pages(spark.readStream.schema(pages.schema).parquet(str(tmp_path / "pages")), trees, str(tmp_path / "check")).awaitTermination(120)
    assert trees.find("x").count() == 3 and trees.find("y").first().title == "Page 1"


def test_versions_of_the_store(spark, tmp_path):
    store = TreeStore(spark, str(tmp_path / "trees"), buckets=4)
    for v in (1, 2, 3):
        store.save(spark.createDataFrame([(f"d{i}", v) for i in range(v, 6)], "document_id string, v int"))
    store.delete("d5")
    store.save(spark.createDataFrame([("d4", 9)], "document_id string, v int"))
    want = {"d1": 1, "d2": 2, "d3": 3, "d4": 9}
    assert {r.document_id: r.v for r in store.all().collect()} == want
    assert store.find("d5").count() == 0 and store.find("d4").first().v == 9
    assert {r.document_id: r.v for r in store.compact(str(tmp_path / "small")).all().collect()} == want
    store.save(spark.createDataFrame([("d5", 7)], "document_id string, v int"))
    assert store.find("d5").first().v == 7


def test_engine(spark, tmp_path):
    from quire.engine import Engine
    from quire.errors import NoPages

    made = Engine(TreeStore(spark, str(tmp_path / "e"), buckets=2), RuleModel(_outline), lambda texts: [[float(len(t)), 1.0] for t in texts])
    pages = spark.createDataFrame([("toc", 1, "LIST"), ("toc", 2, "x" * 40), ("md", 1, "# A\n# B\n# C")], "document_id string, page_number int, text string")
    asked = spark.createDataFrame([("none",)], "document_id string")
    got = {r.document_id: (r.indexing_method, r.error_code) for r in made.build(pages, documents=asked).collect()}
    assert got == {"toc": ("TOC_WITHOUT_PAGES", None), "md": ("HEADER_BASED", None), "none": (None, "NO_PAGES_PROVIDED")}
    changed = made.build(pages.filter("document_id = 'md'").withColumn("text", F.lit("# Z\n# Y\n# X"))).collect()
    assert len(changed) == 1 and "A" in {r.title for r in made.store.find("md").collect()}
    assert all(len(r.embedding) == 2 for r in made.store.find("md").collect())
    with pytest.raises(NoPages):
        made.build_one("empty", [])
    with pytest.raises(ValueError):
        Engine(made.store, max_nodes=0)


def _broken(messages, tags):
    raise RuntimeError


def test_failed_calls_fail_no_job(spark):
    from quire.config import IndexingConfig
    from quire.operators import tree

    pages = spark.createDataFrame([("d", 1, "# A\n# B\n# C")], "document_id string, page_number int, text string")
    nodes = tree.build(__import__("quire.operators.detect", fromlist=["x"]).by_headers(pages, IndexingConfig(min_header_count=2)), pages)
    model = RuleModel(_broken)
    queries = nodes.select("document_id").distinct().select("document_id", F.lit("q").alias("query_id"), F.lit("?").alias("query"))
    assert [r.error_code for r in answer.search(nodes, tree.compact_json(nodes), queries, model).collect()] == ["ERROR"]
    entries = spark.createDataFrame([("d", 1, "A", None, 1, 1, None, "X", None)], "document_id string, entry_pos int, title string, page_number int, physical_index int, level int, structure string, method string, last_content_page int")
    verified = with_model.verify(entries, pages, model)
    assert [r.correct for r in verified.collect()] == [None]
    assert with_model.fix(entries, verified.withColumn("correct", F.lit(False)), pages, model, IndexingConfig()).first().physical_index == 1
    assert with_model.embed(nodes, lambda texts: 1 / 0).count() == 0
    assert with_model.accuracy(verified.filter("false"), pages).first().accuracy == 1.0
    empty = spark.createDataFrame([], "score string, query_ms long, index_ms long")
    assert answer.summary(empty).first().accuracy == 0.0
