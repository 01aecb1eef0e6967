"""Streaming ingest of pages into a tree store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quire.config import IndexingConfig
from quire.operators import detect, tree
from quire.operators.store import TreeStore


def index_pages(pages: DataFrame, store: TreeStore, checkpoint: str, config: IndexingConfig | None = None, **trigger) -> StreamingQuery:
    """Each micro-batch's documents that the store doesn't hold are detected, built and saved.

    A document's pages must arrive together; a batch that is run again finds its documents stored.
    """
    config = config or IndexingConfig()

    def batch(rows: DataFrame, _: int) -> None:
        new = store.missing(rows).persist()
        if not new.isEmpty():
            store.save(tree.split_oversized(tree.build(detect.detect(new, config), new), config.max_node_text_length))
        new.unpersist()

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
