"""Incremental ingest with Structured Streaming (STR1-STR5, MRG7).

Raw messages are read as files arrive.  Keyed state remembers the content of every message,
across restarts, so one that is delivered again is dropped before it is parsed.  There is no
event-time watermark: a message that is half a year late is as welcome as any.

The ledger is a folder.  A batch appends its parsed rows as ``deltas/stream=S/batch=N``, where S names
the checkpoint, and rewrites nothing; readers fold rows by key (``merge.upsert``).  ``compact``
folds what there is into ``base/v=K``, which says up to which batch of each stream it goes; a
reader takes the newest complete base and the later batches.

Replays: a batch that runs again because the run stopped between its write and Spark's commit
replaces what it wrote; one that a base has covered meanwhile is skipped.  A stream with a new
checkpoint delivers everything again, and keys decide that nothing is new."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pursebook.operators import merge

#: State of very many messages belongs on disk, not in an executor's heap.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}
COVERED = "stream string, upto long"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder where the cluster shares files; in local mode a temporary one if none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="pursebook-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _children(spark: SparkSession, folder: str) -> list[str]:
    fs, path = _files(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def _complete(spark: SparkSession, folder: str) -> bool:
    fs, _ = _files(spark, folder)
    return fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS"))


def _delete(spark: SparkSession, folder: str) -> None:
    fs, path = _files(spark, folder)
    fs.delete(path, True)


def bases(spark: SparkSession, folder: str) -> list[int]:
    """The complete bases, oldest first; what a base covers is written last."""
    found = [int(n[2:]) for n in _children(spark, f"{folder}/base") if n.startswith("v=")]
    return [v for v in sorted(found) if _complete(spark, f"{folder}/base/v={v}/covered")]


def covered(spark: SparkSession, folder: str, v: int | None) -> dict[str, int]:
    """The last batch of each stream that a base holds."""
    return {r.stream: r.upto for r in spark.read.schema(COVERED).parquet(f"{folder}/base/v={v}/covered").collect()} if v is not None else {}


def deltas(spark: SparkSession, folder: str, after: dict[str, int]) -> list[tuple[str, int]]:
    """(stream, batch) of the complete batches that come after."""
    found = []
    for name in _children(spark, f"{folder}/deltas"):
        stream = name.removeprefix("stream=")
        numbers = sorted(int(b[6:]) for b in _children(spark, f"{folder}/deltas/{name}") if b.startswith("batch="))
        found += [(stream, n) for n in numbers if n > after.get(stream, -1) and _complete(spark, f"{folder}/deltas/{name}/batch={n}")]
    return found


def _parts(spark: SparkSession, folder: str, schema) -> tuple[DataFrame, DataFrame, list[tuple[str, int]], int | None]:
    """(base, rows of later batches, those batches, the base's number)."""
    v = max(bases(spark, folder), default=None)
    later = deltas(spark, folder, covered(spark, folder, v))
    table = lambda paths: spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return table([f"{folder}/base/v={v}/rows"] if v is not None else []), table([f"{folder}/deltas/stream={s}/batch={n}" for s, n in later]), later, v


def read_ledger(spark: SparkSession, folder: str, schema, order: tuple[str, ...] = ("arrival", "id")) -> DataFrame:
    """The ledger: base and later batches, folded by key."""
    base, rows, later, _ = _parts(spark, folder, schema)
    return merge.upsert(base, rows, order) if later else base


def compact(spark: SparkSession, folder: str, schema, order: tuple[str, ...] = ("arrival", "id")) -> None:
    """Fold base and batches into a new base.  Bases before the last one go, and batches that the
    last one had already: a reader that began before may still need the rest."""
    base, rows, later, v = _parts(spark, folder, schema)
    if not later:
        return
    had = covered(spark, folder, v)
    new = f"{folder}/base/v={0 if v is None else v + 1}"
    merge.upsert(base, rows, order).write.mode("overwrite").parquet(f"{new}/rows")
    upto = had | {s: max(n for t, n in later if t == s) for s in {s for s, _ in later}}
    spark.createDataFrame(sorted(upto.items()), COVERED).coalesce(1).write.mode("overwrite").parquet(f"{new}/covered")
    for old in bases(spark, folder)[:-2]:
        _delete(spark, f"{folder}/base/v={old}")
    for stream, last in had.items():
        for name in _children(spark, f"{folder}/deltas/stream={stream}"):
            if name.startswith("batch=") and int(name[6:]) <= last:
                _delete(spark, f"{folder}/deltas/stream={stream}/{name}")


def append_batch(folder: str, stream: str, parse: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: the batch's rows under its number, unless a base has them."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number <= covered(spark, folder, max(bases(spark, folder), default=None)).get(stream, -1):
            batch.write.format("noop").mode("overwrite").save()  # the state must still learn of its messages
            return
        parse(batch).write.mode("overwrite").parquet(f"{folder}/deltas/stream={stream}/batch={number}")

    return run


def ingest(messages: DataFrame, ledger: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame], message_key: tuple[str, ...] | None = None) -> StreamingQuery:
    """Process what a streaming DataFrame of messages has, then stop.  Messages that agree in
    ``message_key`` (in all columns, if it is not given) are one, whenever they arrive."""
    spark = messages.sparkSession
    once = messages.dropDuplicates(list(message_key) if message_key else None)
    stream = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:  # a stream takes its settings when it starts
        return once.writeStream.foreachBatch(append_batch(ledger, stream, parse)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ingest_available(spark: SparkSession, inbox: str, schema: str, ledger: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame], message_key: tuple[str, ...] | None = None) -> StreamingQuery:
    """Process the JSON files that have arrived since the last run, then stop."""
    return ingest(spark.readStream.schema(schema).json(inbox), ledger, checkpoint, parse, message_key)
