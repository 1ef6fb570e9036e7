"""Reads as a stream: each read is decomposed on its own, so micro-batches need no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..params import Options
from ..plans.decompose import decompose


def decompose_stream(reads: DataFrame, monomers: DataFrame, path: str, checkpoint: str, options: Options = Options(), available_now: bool = True) -> StreamingQuery:
    """Start a query that appends each micro-batch's final table to ``path`` as Parquet.

    A batch is written below a folder of its number, so a batch that runs again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        decompose(batch, monomers, options).final.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = reads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
