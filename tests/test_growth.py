"""What is shuffled and sent follows the input, not the number of nodes that show a page."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.config import IndexingConfig
from quire.functions.arrow import rounded
from quire.models.chat import RuleModel
from quire.operators import answer, detect, retrieve, tree, with_model
from quire.plans import catalogue

HEADS, CONFIG = 600, IndexingConfig(min_header_count=2)


def shuffled(spark, rows) -> float:
    """MB that are shuffled while the rows are made."""
    total = lambda: sum(x.totalShuffleWrite() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    before = total()
    rows.write.format("noop").mode("overwrite").save()
    return (total() - before) / 1e6


@pytest.fixture(scope="module")
def one_page(spark):
    """600 headings on a page of 150 KB that doesn't compress: 90 MB if every leaf gets a copy of its text."""
    random.seed(1)
    text = "\n".join(f"# Title {i}\n{random.randbytes(120).hex()}" for i in range(HEADS))
    pages = spark.createDataFrame([("d", 1, text)], "document_id string, page_number int, text string").persist()
    return text, pages, tree.sections(detect.by_headers(pages, CONFIG), pages).persist()


def test_texts_of_a_shared_page(spark, one_page):
    text, pages, _ = one_page
    nodes = tree.build(detect.by_headers(pages, CONFIG), pages)
    assert shuffled(spark, nodes) < 5
    assert nodes.filter(F.col("text") == text).count() == HEADS


def test_selection_and_search_of_a_shared_page(spark, one_page):
    text, pages, nodes = one_page
    chosen = spark.createDataFrame([("d", "q", ["0002", "0001", "9"], "r")], "document_id string, query_id string, node_ids array<string>, reasoning string")
    got = retrieve.select_nodes(nodes, chosen, pages=pages)
    assert shuffled(spark, got) < 5
    assert got.first().sections_text == "\n".join(f"--- Section: Title {i} (Pages 1-1) ---\n{text}" for i in (0, 1))
    queries = spark.createDataFrame([("d", "q", "title 3")], "document_id string, query_id string, query string")
    model = RuleModel(lambda messages, tags: '{"selected_node_ids": ["0003"], "reasoning": "r"}')
    assert answer.search(nodes, tree.compact_json(nodes), queries, model, pages=pages).first().sections_text.endswith(text)


def test_hybrid_of_a_shared_page(spark, one_page):
    text, pages, nodes = one_page
    queries = spark.createDataFrame([("d", "q", "title 3", [1.0])], "document_id string, query_id string, query string, vector array<double>")
    vectors = nodes.select("document_id", "node_id", F.array(F.lit(1.0)).alias("embedding"))
    got = retrieve.hybrid(nodes, vectors, queries, pages=pages)
    assert shuffled(spark, got) < 5 and got.first().sections_text.count(text) == 5
    whole = retrieve.bm25(tree.with_text(nodes, pages), queries.select("document_id", "query_id", "query"))
    assert sorted(whole.collect()) == sorted(retrieve.bm25(nodes, queries.select("document_id", "query_id", "query"), pages).collect())


def test_model_calls_see_whole_texts(spark, one_page):
    text, pages, nodes = one_page
    made = with_model.embed(nodes, lambda texts: [[len(t)] for t in texts], pages)
    assert shuffled(spark, made) < 5
    assert {r.embedding[0] for r in made.collect()} == {len(f"Title {i}: {text}") for i in range(HEADS)}

    def told(messages, tags):
        import json
        import re

        shown = messages[-1][1]
        return json.dumps({"items": [{"node_id": n, "summary": str(shown.count(text))} for n in re.findall(r"(?m)^\[(\d+)\]", shown)]})

    got = with_model.summarize(nodes, RuleModel(told), CONFIG, pages)
    assert shuffled(spark, got) < 5 and [r.summary for r in got.collect()] == ["10"] * HEADS


def test_the_summariser_reads_headings_like_its_pattern():
    import json
    import re

    random.seed(2)
    for _ in range(2000):
        text = "".join(random.choice("[]\n a1") for _ in range(40))
        want = [{"node_id": i, "summary": t[:40]} for i, t in re.findall(r"(?m)^\[([^\]]+)\] [^\n]*\n([^\n]*)", text)]
        assert json.loads(catalogue._first_words([("user", text)], []))["items"] == want


def test_rounding_is_that_of_spark(spark):
    random.seed(3)
    values = [random.uniform(-1, 1) for _ in range(2000)] + [k / 1e6 + 5e-7 for k in range(-500, 500)] + [0.1234565, -0.0000005, 1.0000005, 0.0]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 6)).collect()]
    assert rounded(np.array(values), 6).tolist() == want


def test_cosines_are_ranked_without_a_shuffle_of_them(spark):
    random.seed(4)
    rows = [(str(i % 2), str(i), i, [random.choice([0.0, 1.0, -1.0, 0.5]) for _ in range(4)]) for i in range(400)]
    nodes = spark.createDataFrame(rows, "document_id string, node_id string, preorder int, embedding array<float>").persist()
    asked = spark.createDataFrame([(str(d), f"q{i}", [random.uniform(-1, 1) for _ in range(4)]) for d in range(2) for i in range(300)], "document_id string, query_id string, vector array<double>").persist()
    got = retrieve.cosine_ranked(nodes.drop("embedding"), nodes, asked)
    assert shuffled(spark, got) < 0.5
    from quire.functions.vectors import cosine

    plain = nodes.join(asked, "document_id").select("document_id", "query_id", "node_id", "preorder", F.round(cosine(F.col("embedding"), F.col("vector")), 6).alias("score"))
    assert sorted(got.collect()) == sorted(retrieve.ranked(plain).collect())
    words = plain.filter("preorder % 3 = 0").withColumn("score", (F.col("preorder") % 7).cast("double"))
    keys = ["document_id", "query_id", "node_id"]
    a, b = retrieve.ranked(words, "wr").select(*keys, "wr"), retrieve.ranked(plain, "vr").select(*keys, "preorder", "vr")
    want = b.join(a, keys, "left").select(*keys, "preorder", F.round(F.coalesce(1.0 / (60 + F.col("wr")), F.lit(0.0)) + 1.0 / (60 + F.col("vr")), 9), F.coalesce("wr", F.lit(2147483647)))
    assert sorted(map(tuple, retrieve.fuse(words, plain).collect())) == sorted(map(tuple, want.collect()))


def test_pages_are_looked_at_once_for_contents(spark, one_page):
    made = detect.by_contents(one_page[1], CONFIG)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_pages_without_headings_are_not_shuffled(spark):
    random.seed(6)
    rows = [("d", i, "x" + random.randbytes(1000).hex()) for i in range(1, 2000)] + [("d", 2000, "a\n# One\nb\n===\n 1.2 Two\n\n **Three**")]
    pages = spark.createDataFrame(rows, "document_id string, page_number int, text string").persist()
    found = detect.header_lines(pages)
    assert shuffled(spark, found) < 0.5 and sorted(r.title for r in found.collect()) == ["One", "Three", "Two", "b"]
