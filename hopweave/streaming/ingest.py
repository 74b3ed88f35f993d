"""Streaming ingest of vectors: each micro-batch is assigned to inverted lists and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import ivf


def into_lists(stream: DataFrame, centroids: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """(vec_id, embedding) stream -> Parquet lists (vec_id, cid, dist, batch) at path; a replayed batch replaces itself."""

    def append(batch: DataFrame, epoch: int) -> None:
        ivf.assign(batch.dropDuplicates(["vec_id"]), centroids).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
