"""Committing the micro-batches of a stream to an archive."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.archive import Archive
from palimpsest.snapshots import SnapshotDescriptor
from palimpsest.sources.documents import from_spark
from palimpsest.sources.files import Files
from palimpsest.store import ChangedMeanwhile, Store

#: Times a batch is merged anew because another writer came first.
ATTEMPTS = 10


def commit_batch(path: str, primary_key: list[str] | None, append: bool = True, stream: str | Callable[[], str] = "") -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` takes. Each batch becomes a version: with ``append`` on top of the rows of the last one, whose rows of equal key it replaces (without a key all its rows are new), else in their place. Of rows of equal key in a batch the last counts.

    ``stream`` names the stream (or says how to find its name). The manifest that
    publishes a version also holds the number of its batch, so a batch that is
    delivered again commits nothing, whatever other streams have committed since. If
    another writer was faster, the batch is merged into what that one left. A batch
    whose version was rolled back isn't committed again.
    """

    def commit(batch: DataFrame, number: int) -> None:
        spark, name = batch.sparkSession, stream() if callable(stream) else stream
        doc = from_spark(batch, order_by=F.monotonically_increasing_id())
        about = SnapshotDescriptor(f"batch {number}", action={"stream": name, "batch": number})
        for attempt in range(ATTEMPTS):
            store = Store(spark, path)
            try:
                if not store.exists():
                    Archive.create(spark, path, doc, primary_key, about, batch=(name, number), fold=append)
                    return
                archive = Archive(store.load())
                if archive.store.manifest.batches.get(name, -1) < number:
                    (archive.upsert if append else archive.commit)(doc, about, batch=(name, number))
                return
            except ChangedMeanwhile:
                if attempt == ATTEMPTS - 1:
                    raise

    return commit


def _stream_id(spark: SparkSession, checkpoint: str) -> Callable[[], str]:
    """The identifier that Spark has given to the stream of a checkpoint."""
    return lambda: json.loads(Files(spark).read(f"{checkpoint}/metadata"))["id"]


def ingest(source: DataFrame, path: str, primary_key: list[str] | None, checkpoint: str, append: bool = True, **trigger) -> StreamingQuery:
    """Start committing a stream; ``trigger`` as of ``writeStream.trigger``. Several streams, each with a checkpoint of its own, may commit to one archive."""
    commit = commit_batch(path, primary_key, append, _stream_id(source.sparkSession, checkpoint))
    return source.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "0 seconds"})).foreachBatch(commit).start()


def ingest_once(source: DataFrame, path: str, primary_key: list[str] | None, append: bool = True, checkpoint: str | None = None) -> Archive:
    """Commit all that the stream has by now, and return the archive."""
    ingest(source, path, primary_key, checkpoint or f"{path}-stream", append, availableNow=True).awaitTermination()
    return Archive.load(source.sparkSession, path)
