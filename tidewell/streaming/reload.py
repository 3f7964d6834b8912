"""Following published snapshots, once or by a stream, with caches by version."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.ingest import Snapshots


class Served:
    """One loaded version; whoever holds ``current`` keeps reading it while the next one is prepared."""

    def __init__(self, snapshots: Snapshots, prepare: Callable[[DataFrame], object] = lambda df: df, release: Callable[[object], None] = lambda _: None):
        self.snapshots, self.prepare, self.release = snapshots, prepare, release
        self.lock, self.loaded, self.current = threading.Lock(), 0, None

    def poll(self) -> bool:
        """Load the newest version if it is newer; a failure leaves what is served."""
        version = self.snapshots.version()  # before the data, so that a later version is seen again next time
        if version <= self.loaded:
            return False
        fresh = self.prepare(self.snapshots.read(version))
        with self.lock:
            old, self.current, self.loaded = self.current, fresh, version
        if old is not None:
            self.release(old)
        return True


def follow(spark: SparkSession, served: Served, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """A stream over the pointer files that polls on each new one; without ``seconds`` it takes what is there and ends."""

    def on_batch(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            served.poll()

    stream = spark.readStream.schema("version long, data string").json(f"{served.snapshots.root}/versions")
    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()
