"""Networks as they are asked for: a stream of parameter rows to sparse voxels on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.network import network_voxels


def write_networks(params: DataFrame, path: str, checkpoint: str, tissue: tuple[int, int, int], depth: int | None = None) -> StreamingQuery:
    """Runs params (a streaming frame) batch by batch; a batch that is run again overwrites its own folder."""

    def batch(rows: DataFrame, number: int) -> None:
        network_voxels(rows, tissue, depth).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return params.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
