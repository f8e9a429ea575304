"""Queries on a stream against a static index (an addition of this engine)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vecinity.operators.search import build_index, lsh_join
from vecinity.plans.lineage import saved


def stream_search(queries: DataFrame, items: DataFrame, family, sink: str, checkpoint: str, **options) -> StreamingQuery:
    """Starts a query that answers each micro-batch of (id, vec) from the stream by bucket join and writes answers as Parquet.

    A batch's folder carries its number and is overwritten if the batch runs again, so each batch counts once."""
    index = saved(build_index(items, family), "stream-index")

    def answer(batch, number):
        lsh_join(batch, items, family, index=index, **options).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
