"""Statements from a stream into a store: what it has an open row of is left out.

The store itself is the state, so a restarted stream goes on from it: a batch that is given again, as happens after a
failure, adds nothing. Triggers bound a batch by files and by time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..model import RDF_TYPE
from ..operators.normalize import normalize
from ..operators.store import Store


def upsert(raw: DataFrame, store: Store, checkpoint: str, load_id: str = "stream", type_predicate: str = RDF_TYPE, every: str | None = None) -> StreamingQuery:
    """Starts the stream raw (RAW, read with maxFilesPerTrigger or maxBytesPerTrigger) into store. With every, a time as
    "30 seconds", it runs on; without it takes what is there and ends. Blank nodes are labelled by load_id, so that a
    repeated delivery is the same."""

    def batch(rows: DataFrame, _: int) -> None:
        store.put(normalize(rows, load_id, type_predicate), versioning=False)

    writer = raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
