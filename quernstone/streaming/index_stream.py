"""Index entries and command scripts as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quernstone.operators.line_index import build


def append_entries(entries: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch of (key, line_no) to the stored index; what a restart repeats is one batch at most."""
    return entries.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: build(batch, path)).start()
