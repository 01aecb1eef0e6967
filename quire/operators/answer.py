"""Search and question answering over stored trees, and the evaluation of answers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.errors import ChatParseFailed, IndexNotFound, SelectionParseFailed
from quire.functions.arrow import bounded_batches
from quire.functions.json_clean import json_object, schema_hint
from quire.models.chat import ChatModel, structured
from quire.operators.retrieve import select_nodes
from quire.operators.tree import compact_json

NO_SECTIONS = "No relevant sections were found in the document for this question."
QA = T.StructType([T.StructField("answer", T.StringType()), T.StructField("reasoning", T.StringType())])


def choose(trees: DataFrame, queries: DataFrame, model: ChatModel, most: int = 5) -> DataFrame:
    """(document_id, query_id, node_ids, reasoning, failed) as the model picks them from each compact tree.

    A call that fails, or a reply that can't be read, leaves its query without nodes and names the error in failed.
    trees: document_id, tree (JSON without texts); queries: document_id, query_id, query.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                asked = [("system", f"Choose at most {most} sections that answer the question.\n{row.tree}"), ("user", row.query)]
                try:
                    got = structured(model, asked, '{"selected_node_ids": "array", "reasoning": "string"}', tags=["node-selection"])
                    out.append((row.document_id, row.query_id, [str(x) for x in got.get("selected_node_ids") or []], str(got.get("reasoning") or ""), None))
                except ChatParseFailed:
                    out.append((row.document_id, row.query_id, [], "", SelectionParseFailed.code))
                except Exception as e:
                    out.append((row.document_id, row.query_id, [], "", getattr(e, "code", "ERROR")))
            yield pd.DataFrame(out, columns=["document_id", "query_id", "node_ids", "reasoning", "failed"])

    bounded_batches(trees.sparkSession)
    return queries.join(trees, "document_id").mapInPandas(run, "document_id string, query_id string, node_ids array<string>, reasoning string, failed string")


def search(nodes: DataFrame, trees: DataFrame, queries: DataFrame, model: ChatModel, most: int = 5, pages: DataFrame | None = None) -> DataFrame:
    """Context of each query from the sections that the model picks; error_code INDEX_NOT_FOUND without a tree, or
    that of the call that failed.  With pages the nodes have no texts yet, and only those picked get theirs."""
    chosen = choose(trees, queries, model, most).persist()  # a reply is asked for once
    failed = chosen.select("document_id", "query_id", "failed")
    found = select_nodes(nodes, chosen.drop("failed"), most, pages).join(failed, ["document_id", "query_id"])
    out = queries.select("document_id", "query_id", "query").join(found, ["document_id", "query_id"], "left")
    return out.withColumn("error_code", F.when(F.col("selected_node_ids").isNull(), IndexNotFound.code).otherwise(F.col("failed"))).drop("failed")


def answer(contexts: DataFrame, model: ChatModel, schema: T.StructType | None = None) -> DataFrame:
    """Contexts with data (JSON of the schema, or the answer's text without one) and its reasoning.

    An empty selection is answered with a fixed text, or by error_code INDEX_NOT_FOUND where a schema is asked for.
    """
    hint, typed = schema_hint(schema or QA), schema is not None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            data, reasons, errors = [], [], []
            for row in frame.itertuples():
                error, text, reason = row.error_code, None, row.reasoning
                if error is None and not len(row.selected_node_ids):
                    error, text = (IndexNotFound.code, None) if typed else (None, NO_SECTIONS)
                elif error is None:
                    try:
                        got = structured(model, [("system", f"Answer from these sections.\n{row.sections_text}"), ("user", row.query)], hint, tags=["tree-query" if typed else "text-query"])
                        text, reason = (json.dumps(got), reason) if typed else (str(got.get("answer") or ""), str(got.get("reasoning") or ""))
                    except Exception as e:
                        error = getattr(e, "code", "ERROR")
                data.append(text)
                reasons.append(reason)
                errors.append(error)
            yield frame.assign(reasoning=reasons, error_code=errors, data=data)

    bounded_batches(contexts.sparkSession)
    return contexts.mapInPandas(run, T.StructType([*contexts.schema, T.StructField("data", T.StringType())]))


def typed(answers: DataFrame, schema: T.StructType) -> DataFrame:
    return answers.withColumn("data", F.from_json("data", schema))


def judge(rows: DataFrame, model: ChatModel) -> DataFrame:
    """Rows of question, expected_answer and actual with score and judge_reasoning; ERROR where there is no verdict."""

    @F.pandas_udf(T.StringType())
    def reply(question: pd.Series, expected: pd.Series, actual: pd.Series) -> pd.Series:
        def one(q, e, a):
            try:
                return None if a is None else model.chat([("user", f"Question: {q}\nExpected: {e}\nActual: {a}\nIs the actual answer CORRECT, PARTIALLY_CORRECT or INCORRECT? Reply as JSON {{score, reasoning}}.")], ["judge"])
            except Exception:
                return None

        return pd.Series([one(*x) for x in zip(question, expected, actual, strict=True)])

    got = F.from_json(json_object(F.col("_reply")), "score string, reasoning string")
    out = rows.withColumn("_reply", reply("question", "expected_answer", "actual"))
    return out.withColumn("score", parse_score(got["score"])).withColumn("judge_reasoning", got["reasoning"]).drop("_reply")


def evaluate(questions: DataFrame, nodes: DataFrame, model: ChatModel, judge_model: ChatModel, pages: DataFrame | None = None) -> DataFrame:
    """Every question answered from its document's tree and judged: the columns of questions with actual, source_pages,
    score and judge_reasoning.

    questions: question_id, document_id, question, expected_answer.  A document that is not indexed, or a call that
    fails, gives a row with the score ERROR; summary() counts them.  With pages the nodes have no texts yet.
    """
    queries = questions.select("document_id", F.col("question_id").alias("query_id"), F.col("question").alias("query"))
    found = answer(search(nodes, compact_json(nodes), queries, model, pages=pages), model)
    found = found.select(F.col("query_id").alias("question_id"), "document_id", F.when(F.col("error_code").isNull(), F.col("data")).alias("actual"), "source_pages", "error_code")
    judged = judge(questions.join(found, ["question_id", "document_id"], "left"), judge_model)
    told = F.concat(F.lit("ERROR: "), F.col("error_code"))
    return judged.withColumn("actual", F.coalesce("actual", told)).withColumn("judge_reasoning", F.coalesce("judge_reasoning", F.col("error_code"))).drop("error_code")


def parse_score(value: Column) -> Column:
    upper = F.upper(F.coalesce(value, F.lit("")))
    return F.when(upper.isin("CORRECT", "PARTIALLY_CORRECT", "INCORRECT"), upper).otherwise("ERROR")


def summary(judged: DataFrame) -> DataFrame:
    """Counts by score, accuracy, and mean times; the mean index time is of the distinct times.  All are 0 without rows."""
    n = F.count(F.lit(1))
    hits = lambda s: F.count_if(F.col("score") == s)
    share = lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))
    return judged.agg(
        n.alias("total_questions"), hits("CORRECT").alias("correct"), hits("PARTIALLY_CORRECT").alias("partial"), hits("INCORRECT").alias("incorrect"), hits("ERROR").alias("errors"),
        F.round(share(hits("CORRECT")), 6).alias("accuracy"), F.round(share(hits("CORRECT") + hits("PARTIALLY_CORRECT")), 6).alias("lenient_accuracy"),
        F.coalesce(F.floor(F.avg("query_ms")), F.lit(0)).alias("avg_query_ms"), F.coalesce(F.floor(F.try_divide(F.sum_distinct("index_ms"), F.count_distinct("index_ms"))), F.lit(0)).alias("avg_index_ms"),
    )
