"""Continuous ingest: a file stream of message listings, merged into a snapshot per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from galley.operators.state import has_snapshot, publish, snapshot, upsert_emails

MESSAGE_SCHEMA = "message_id string, thread_id string, sender string, subject string, snippet string, received_at string, label_ids array<string>"
EMAIL_SCHEMA = "id long, message_id string, subject string, sender string, body_preview string, status string, retry_count int, error_message string, received_at string, created_at timestamp, updated_at timestamp"


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Merges every new Parquet file of ``source`` into the snapshot folder ``target``, then stops.

    A batch that is run again after a failure gives the same rows: the merge is
    by message_id and overwrites.
    """

    def merge(batch: DataFrame, _: int) -> None:
        s = batch.sparkSession
        current = snapshot(s, target) if has_snapshot(s, target) else s.createDataFrame([], EMAIL_SCHEMA)
        publish(upsert_emails(current, batch, F.current_timestamp()), target)

    stream = spark.readStream.schema(MESSAGE_SCHEMA).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
