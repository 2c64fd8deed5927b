"""Streams into and against a store: new records are appended batch by batch, incoming queries are resolved against it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kinsieve.plans.resolve import Resolver
from kinsieve.sources.store import OWN_TEXT, ParquetStore, is_saved


def append_stream(records: DataFrame, store: ParquetStore, path: str, checkpoint: str) -> StreamingQuery:
    """Append each batch of a record stream to the store saved at ``path``; ``store`` is saved there first if nothing is.

    A batch writes files of its own. Its number is kept with the store, by the stream's checkpoint: a batch that runs again, or a stream that
    starts again, adds nothing twice and takes nothing back.
    """
    if not is_saved(records.sparkSession, path):
        store.save(path)
    text = store.text if store.strategy == OWN_TEXT else None

    def add(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            ParquetStore.append(batch.sparkSession, path, batch, checkpoint, number, store.embedder, text)

    return records.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()


def resolve_stream(queries: DataFrame, resolver: Resolver, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Give each batch of a query stream its matches, to ``sink(matches, number)``."""

    def one(batch: DataFrame, number: int) -> None:
        sink(resolver.resolve(batch), number)

    return queries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
