"""Incremental linkage: batches of new records are linked with the entities as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.blocking import FAMILIES, block_pairs, top_candidates
from ..operators.normalize import normalize


def link_stream(records: DataFrame, entities: DataFrame, path: str, checkpoint: str, k: int = 10, families: tuple[str, ...] = FAMILIES) -> StreamingQuery:
    """Writes the best candidates of each micro-batch of records (a stream) below path, one folder a batch.

    A batch that is repeated after a failure overwrites its own folder, so every record counts once.
    """
    normal = normalize(entities)

    def write(batch: DataFrame, number: int) -> None:
        found = top_candidates(block_pairs(normal, normalize(batch), families), k)
        found.select("country", "s1", "r", "nk", "score", "cos", "rank").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
