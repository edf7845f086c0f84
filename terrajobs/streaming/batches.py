"""The jobs over streams, a micro-batch at a time.

Matching, locating and geocoding hold no state, but they work on distinct keys, which a stream has none of; a micro-batch has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def enrich_stream(stream: DataFrame, job: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Apply a batch job to every micro-batch and write its rows under ``sink``, one folder a batch.

    A batch that is tried again overwrites its own folder, so each input row is enriched once in the output.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
