"""Derived inputs for the catalogue, each as a DataFrame and as the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.sources import pages as P


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.from_lines(table(spark, sf_dir, "documents"))


DOC_PAGES = """doc_lines AS (SELECT doc_id::VARCHAR AS document_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS ls FROM documents WHERE text IS NOT NULL),
doc_pages AS (SELECT document_id, generate_subscripts(ls, 1)::INT AS page_number, unnest(ls) AS text FROM doc_lines)"""


def md_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each region; a page for each nation, with headings of three levels and a fenced block."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    place = F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey"))
    people = customer.withColumn("k", place).groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("k", "c_name", "c_mktsegment"))).alias("c"))
    body = F.array_join(F.transform("c", lambda x: F.concat(F.lit("### "), x["c_name"], F.lit("\n"), F.lower(x["c_mktsegment"]), F.lit(" goods for "), x["c_name"])), "\n")
    rows = nation.join(people, nation.n_nationkey == people.c_nationkey, "left").join(region, nation.n_regionkey == region.r_regionkey)
    page = F.row_number().over(W.partitionBy("r_regionkey").orderBy("n_name"))
    rows = rows.withColumn("page_number", page)
    text = F.concat(
        F.when(F.col("page_number") == 1, F.concat(F.lit("# "), F.col("r_name"), F.lit("\n"))).otherwise(""), F.lit("## "), F.col("n_name"), F.lit("\nA market of "), F.lower("n_name"),
        F.lit("\n```\n# no heading\n```\n"), F.col("n_name"), F.lit(" trade\n===\n**Notes**\n"), F.coalesce(body, F.lit("")), F.lit("\n2.1 Closing\nnone"),
    )
    return rows.select(F.col("r_regionkey").cast("string").alias("document_id"), "page_number", text.alias("text"))


MD_PAGES = """people AS (SELECT c_nationkey, string_agg('### ' || c_name || chr(10) || lower(c_mktsegment) || ' goods for ' || c_name, chr(10) ORDER BY k) AS body
  FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer) GROUP BY c_nationkey),
numbered AS (SELECT r_regionkey::VARCHAR AS document_id, r_name, n_name, body, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_name)::INT AS page_number
  FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN people ON c_nationkey = n_nationkey),
md_pages AS (SELECT document_id, page_number, CASE WHEN page_number = 1 THEN '# ' || r_name || chr(10) ELSE '' END || '## ' || n_name || chr(10) || 'A market of ' || lower(n_name) || chr(10) || '```' || chr(10) || '# no heading' || chr(10) || '```' || chr(10)
  || n_name || ' trade' || chr(10) || '===' || chr(10) || '**Notes**' || chr(10) || coalesce(body, '') || chr(10) || '2.1 Closing' || chr(10) || 'none' AS text FROM numbered)"""


def toc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each part size: page 1 lists its sections in changing styles, two pages each follow."""
    part = table(spark, sf_dir, "part")
    rows = part.withColumn("k", F.row_number().over(W.partitionBy("p_size").orderBy("p_partkey")))
    doc, number = F.col("p_size").cast("string").alias("document_id"), F.col("k").cast("string")
    page = (2 * F.col("k") - 1).cast("string")
    gap = F.when(F.col("k") % 5 == 1, " ..... ").when(F.col("k") % 5 == 2, "\t").when(F.col("k") % 5 == 3, " --").when(F.col("k") % 5 == 4, "   ").otherwise(" …… ")
    line = F.concat(number, F.when(F.col("k") % 2 == 0, ".1 ").otherwise(".0 "), F.col("p_name"), gap, page)
    toc = rows.groupBy("p_size").agg(F.concat(F.lit("TABLE OF CONTENTS\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("l")))), lambda x: x["l"]), "\n")).alias("text"))
    toc = toc.select(doc, F.lit(1).alias("page_number"), "text")
    body = rows.select(doc, F.col("k"), "p_name", "p_type", F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    body = body.select("document_id", (2 * F.col("k") + F.col("i")).cast("int").alias("page_number"), F.when(F.col("i") == 0, F.concat("p_name", F.lit("\n"), F.lower("p_type"))).otherwise(F.concat(F.lit("more about "), F.lower("p_type"))).alias("text"))
    return toc.unionByName(body)


TOC_PAGES = """parts AS (SELECT *, p_size::VARCHAR AS document_id, k::VARCHAR || CASE WHEN k % 2 = 0 THEN '.1 ' ELSE '.0 ' END || p_name AS heading FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS k FROM part)),
toc_pages AS (SELECT document_id, 1 AS page_number, 'TABLE OF CONTENTS' || chr(10) || string_agg(heading || CASE k % 5 WHEN 1 THEN ' ..... ' WHEN 2 THEN chr(9) WHEN 3 THEN ' --' WHEN 4 THEN repeat(chr(160), 3) ELSE ' ' || repeat(chr(8230), 2) || ' ' END || (2 * k - 1)::VARCHAR, chr(10) ORDER BY k) AS text FROM parts GROUP BY document_id
  UNION ALL SELECT document_id, (2 * k)::INT, p_name || chr(10) || lower(p_type) FROM parts UNION ALL SELECT document_id, (2 * k + 1)::INT, 'more about ' || lower(p_type) FROM parts)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as nodes: document by label, node by id."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("document_id"), F.col("vec_id").cast("string").alias("node_id"), F.col("vec_id").cast("int").alias("preorder"), "embedding")


VECTORS = "vectors AS (SELECT label::VARCHAR AS document_id, vec_id::VARCHAR AS node_id, vec_id::INT AS preorder, embedding FROM embeddings)"


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON as models write it: fenced, with a trailing comma, with None, or inside prose."""
    e = table(spark, sf_dir, "events")
    body = F.concat(F.lit('{"eventType": "'), F.col("event_type"), F.lit('", "userId": '), F.col("user_id").cast("string"), F.lit(', "maxHTTPSize": null'))
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("}\n```"))).when(k == 1, F.concat(body, F.lit(", }"))).when(k == 2, F.concat(F.lit("Here it is: "), F.replace(body, F.lit("null"), F.lit("None")), F.lit("} as asked"))).otherwise(F.concat(body, F.lit(" oops")))
    return e.select(F.col("event_id").alias("id"), text.alias("response"))


REPLIES = """bodies AS (SELECT event_id AS id, '{"eventType": "' || event_type || '", "userId": ' || user_id::VARCHAR || ', "maxHTTPSize": null' AS body FROM events),
replies AS (SELECT id, CASE id % 4 WHEN 0 THEN '```json' || chr(10) || body || '}' || chr(10) || '```' WHEN 1 THEN body || ', }' WHEN 2 THEN 'Here it is: ' || replace(body, 'null', 'None') || '} as asked' ELSE body || ' oops' END AS response FROM bodies)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged answers made of labels."""
    l = table(spark, sf_dir, "labels")
    score = F.when(F.col("toxic") == 1, "ERROR").when(F.col("quality") == 0, "INCORRECT").when(F.col("doc_id") % 5 == 0, "PARTIALLY_CORRECT").otherwise("CORRECT")
    return l.select(F.col("doc_id").cast("string").alias("question_id"), score.alias("score"), F.when(score == "ERROR", 0).otherwise(F.col("doc_id") % 97 + 10).cast("long").alias("query_ms"), (F.col("doc_id") % 11 * 100).cast("long").alias("index_ms"))


JUDGED = """judged AS (SELECT *, CASE WHEN score = 'ERROR' THEN 0 ELSE d % 97 + 10 END::BIGINT AS query_ms FROM (SELECT doc_id AS d, doc_id::VARCHAR AS question_id,
  CASE WHEN toxic = 1 THEN 'ERROR' WHEN quality = 0 THEN 'INCORRECT' WHEN doc_id % 5 = 0 THEN 'PARTIALLY_CORRECT' ELSE 'CORRECT' END AS score, (doc_id % 11 * 100)::BIGINT AS index_ms FROM labels))"""
