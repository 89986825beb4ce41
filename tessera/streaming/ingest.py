"""Incremental ingest with Structured Streaming.

New report files -> text -> vectors -> append, each id stored once. The ids seen
are the stream's own keyed state (streaming ``dropDuplicates`` on RocksDB, with
changelog checkpoints), so a micro-batch costs what is new in it, however large
the store has grown. Rows that other writers put into the store are found by an
anti-join over the buckets that the batch touches.

A micro-batch is one run of the store, named by the stream and the batch number:
a batch replayed after an executor or driver loss, and a file landed twice, add
nothing. Of several rows of one id the first to arrive is stored; inside one
micro-batch that is any of them. Rows without an id are left out.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.session import checkpoint_dir
from tessera.sources.readers import REPORT_SCHEMA, append_vectors, stored_vectors

_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def ingest_stream(spark: SparkSession, src: str, vectors_path: str, checkpoint: str | None = None,
                  fmt: str = "parquet", embed_fn=None, max_files_per_trigger: int = 64,
                  available_now: bool = True) -> StreamingQuery:
    """Start the ingest stream; with ``available_now`` it stops when caught up."""
    ckpt = checkpoint or f"{checkpoint_dir(spark)}/ingest-{uuid.uuid4().hex}"
    origin = "stream-" + hashlib.md5(ckpt.encode()).hexdigest()[:16]
    reader = spark.readStream.schema(REPORT_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        reader = reader.options(header="true", multiLine="true", quote='"', escape='"')
    stream = (reader.format(fmt).load(src).select("id", "component", "summary", "description")
              .filter("id IS NOT NULL").dropDuplicates(["id"]))

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        rows = batch.persist()  # the append may look at the ids before it embeds
        try:
            append_vectors(rows, vectors_path, embed_fn, run=f"{origin}-{epoch_id}", origin=origin)
        finally:
            rows.unpersist()

    w = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:  # a query keeps the settings that it was started with
        return w.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_store(spark: SparkSession, vectors_path: str) -> DataFrame:
    return stored_vectors(spark, vectors_path)
