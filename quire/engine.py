"""One call from pages to stored trees, and from questions to answers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.config import MAX_NODES, IndexingConfig
from quire.errors import DetectionFailed, IndexNotFound, NoPages
from quire.models.chat import ChatModel
from quire.operators import answer, tree, with_model
from quire.operators.detect import detect
from quire.operators.store import TreeStore


@dataclass(frozen=True)
class Engine:
    """A store with the models that build and question it.

    Without a model the chain is contents pages, headings and flat chunks; with one the model's detectors stand
    before the flat chunks.  Without an embedder the nodes have no vectors.
    """

    store: TreeStore
    model: ChatModel | None = None
    embedder: Callable[[list[str]], list[Sequence[float]]] | None = None
    cache: object = None
    max_nodes: int = MAX_NODES

    def __post_init__(self):
        if self.max_nodes < 1:
            raise ValueError(f"max_nodes must be positive, was {self.max_nodes}")

    def build(self, pages: DataFrame, config: IndexingConfig | None = None, documents: DataFrame | None = None) -> DataFrame:
        """Build and save what is not stored yet; (document_id, total_nodes, total_pages, max_depth, indexing_method,
        error_code) of the documents of pages, and of those given in documents.

        A stored document stays as it is, whatever its pages are now; its indexing_method is that of its tree.
        """
        config = config or IndexingConfig()
        new = self.store.missing(pages).persist()
        if not new.isEmpty():
            more = ()
            if self.model is not None:
                more = (with_model.by_discovered_patterns(self.model, self.cache), with_model.by_unnumbered_contents(self.model), with_model.by_outline(self.model))
            entries = detect(new, config, more).persist()
            nodes = tree.split_oversized(tree.build(entries, new), config.max_node_text_length)
            if self.embedder is not None:
                nodes = nodes.persist()
                nodes = nodes.join(with_model.embed(nodes, self.embedder), ["document_id", "node_id"], "left")
            else:
                nodes = nodes.withColumn("embedding", F.lit(None).cast("array<double>"))
            total = new.groupBy("document_id").agg(F.count(F.lit(1)).cast("int").alias("total_pages"))
            method = entries.groupBy("document_id").agg(F.first("method").alias("indexing_method"))
            self.store.save(nodes.join(total, "document_id").join(method, "document_id"))
            entries.unpersist()
        new.unpersist()
        wanted = pages.select("document_id", F.lit(True).alias("paged")).distinct()
        if documents is not None:
            wanted = documents.select("document_id").distinct().join(wanted, "document_id", "full_outer")
        about = self.store.all().groupBy("document_id").agg(F.count(F.lit(1)).cast("int").alias("total_nodes"), F.first("total_pages").alias("total_pages"), F.max("depth").alias("max_depth"), F.first("indexing_method").alias("indexing_method"))
        error = F.when(F.col("total_nodes").isNotNull(), None).when(F.col("paged"), DetectionFailed.code).otherwise(NoPages.code)
        return wanted.join(about, "document_id", "left").withColumn("error_code", error).drop("paged")

    def build_one(self, document_id: str, pages: Sequence[tuple[int, str]], config: IndexingConfig | None = None) -> DataFrame:
        """The nodes of one document, built unless stored; raises where build() would name an error."""
        if not pages and self.store.find(document_id) is None:
            raise NoPages
        rows = self.store.spark.createDataFrame([(document_id, n, t) for n, t in pages], "document_id string, page_number int, text string")
        self.build(rows, config)
        found = self.store.find(document_id)
        if found is None or found.isEmpty():
            raise DetectionFailed if pages else NoPages
        return found

    def search(self, queries: DataFrame) -> DataFrame:
        """Context of each (document_id, query_id, query), with error_code."""
        nodes = self._nodes()
        return answer.search(nodes, tree.compact_json(nodes), queries, self.model, self.max_nodes)

    def query(self, queries: DataFrame, schema: T.StructType | None = None) -> DataFrame:
        """Answers: text, or of the schema."""
        found = answer.answer(self.search(queries), self.model, schema)
        return found if schema is None else answer.typed(found, schema)

    def evaluate(self, questions: DataFrame, judge: ChatModel) -> DataFrame:
        """Every question answered and judged; a document that is not stored gives ERROR."""
        return answer.evaluate(questions, self._nodes(), self.model, judge)

    def _nodes(self) -> DataFrame:
        nodes = self.store.all()
        if nodes is None:
            raise IndexNotFound
        return nodes.select(*tree.NODE)
