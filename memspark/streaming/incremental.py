"""Incremental ingestion with Structured Streaming: high-water marks, late data and idempotence stated by the watermark, merges of changed sources, progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from memspark.store import Corpus


def read_stream(spark: SparkSession, path: str, schema: StructType, ts: str, lateness: str, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files as they arrive; rows later than ``lateness`` behind the newest are late. Offsets are kept by the checkpoint and committed after publishing."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path).withWatermark(ts, lateness)


def new_rows(stream: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys have not come within the watermark: repeated deliveries change nothing. State is dropped behind the watermark."""
    return stream.dropDuplicatesWithinWatermark(list(keys))


def marks(stream: DataFrame, channel: str, ts: str, key: str, window: str = "1 day") -> DataFrame:
    """channel, day window, last key and mark: the high-water mark of each channel in each closed window."""
    return stream.groupBy(F.window(ts, window), channel).agg(F.max(ts).alias("mark"), F.max_by(key, F.struct(ts, key)).alias("last"), F.count("*").alias("n")).select(channel, F.col("window.start").alias("start"), "mark", "last", "n")


def latest_marks(found: DataFrame, channel: str) -> DataFrame:
    """channel, mark, last: the greatest mark of each channel over its windows."""
    return found.groupBy(channel).agg(F.max(F.struct("mark", "last")).alias("m")).select(channel, "m.*")


def run_once(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Processes what is there and stops; the parquet sink commits each batch once."""
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def merge_into(stream: DataFrame, corpus: Corpus, checkpoint: str, source: str = "stream") -> StreamingQuery:
    """Adds each batch of rows in the readers' shape to a corpus: new content is appended, and chunks of a root in the batch whose content did not come with it become
    inactive. A batch is one commit and its content is known by hash, so a batch that runs twice changes nothing more. A root's chunks must come in one batch."""

    def add(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            corpus._add(batch, None, {"kind": "stream", "source": source, "batch": number})

    q = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


class Progress(StreamingQueryListener):
    """Hands each batch's number, rows and watermark, and each end with its error, to a callback. Add it with ``spark.streams.addListener``."""

    def __init__(self, tell: Callable[[dict], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        self.tell({"stage": "started", "id": str(event.id)})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.tell({"stage": "batch", "id": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "watermark": (p.eventTime or {}).get("watermark")})

    def onQueryIdle(self, event) -> None:
        self.tell({"stage": "idle", "id": str(event.id)})

    def onQueryTerminated(self, event) -> None:
        self.tell({"stage": "ended", "id": str(event.id), "error": event.exception})
