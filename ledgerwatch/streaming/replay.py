"""Replay of prepared events in their order, at a pace, up to a number of events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ledgerwatch.operators.replay import to_replay_request, validate_replay
from ledgerwatch.operators.sampling import limit_rows
from ledgerwatch.sources.files import file_system, number_rows

BATCH = "replay_batch"
# What a micro-batch of a replay without pace takes at most, one staged file at least.
BYTES_PER_TRIGGER = 1 << 30


@dataclass(frozen=True)
class Staged:
    """A folder of events in files of one micro-batch each, and their schema."""

    path: str
    events: DataFrame
    batches: int


def stage_replay(
    events: DataFrame, path: str, rows_per_batch: int, max_events: int | None = None
) -> Staged:
    """Cuts events into files of ``rows_per_batch`` consecutive rows in the order of
    ``row_number`` (which may have gaps), and gives the files' times that order: a file stream
    admits files by time, and leaves open which of two files of one instant comes first.
    ``max_events`` ends the replay after so many events of the input, whatever becomes of
    them."""
    if rows_per_batch < 1:
        raise ValueError("a micro-batch needs a row")
    spark = events.sparkSession
    source = number_rows(events.withColumnRenamed("row_number", "__order"), "__order")
    source = source.drop("__order").select(events.columns)
    if max_events is not None:
        source = limit_rows(source, max_events, at_least=1)
    number = F.floor((F.col("row_number") - 1) / rows_per_batch).cast("long")
    cut = source.withColumn(BATCH, number)
    cut.repartition(BATCH).sortWithinPartitions("row_number").write.partitionBy(BATCH).parquet(path)
    store, of = file_system(spark, path)
    # One file for each micro-batch, as many as the stream will run.
    folders = [s.getPath() for s in store.listStatus(of(path)) if s.isDirectory()]
    order = sorted(folders, key=lambda p: int(p.getName().split("=")[1]))
    first = None
    for place, folder in enumerate(order):
        for status in store.listStatus(folder):
            if status.getPath().getName().startswith("part-"):
                first = status.getModificationTime() if first is None else first
                store.setTimes(status.getPath(), first - 1000 * (len(order) - place), -1)
    return Staged(path, events, len(order))


class ReplayProgress(StreamingQueryListener):
    """Rows that each micro-batch of the queries of one run took in, in order."""

    def __init__(self, name: str) -> None:
        self.name = name
        self.rows: dict[int, int] = {}
        self.ended = False

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.name == self.name and progress.numInputRows:
            self.rows[progress.batchId] = progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended = True


def replay_paced(
    spark: SparkSession,
    staged: Staged,
    target: str,
    checkpoint: str,
    prefix: str | None = None,
    every: str | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Sends staged events in order: check, shape to requests, append as JSON below
    ``target``, a folder for each staged file that has requests.

    With ``every`` (like ``1 second``) a micro-batch is one file and starts at that interval,
    so the rate is ``rows_per_batch`` for each; the query then runs until it is stopped.
    Without it there is no pace to keep: a micro-batch takes the next files up to
    ``BYTES_PER_TRIGGER``, and the query ends. A restart goes on after the last micro-batch
    that was written, and writes the folders of an interrupted one again.
    """
    stream = spark.readStream.schema(
        staged.events.withColumn(BATCH, F.lit(0).cast("long")).schema
    )
    if every:
        stream = stream.option("maxFilesPerTrigger", 1)
    else:
        stream = stream.option("maxBytesPerTrigger", BYTES_PER_TRIGGER)
    stream = stream.parquet(staged.path)

    def send(batch: DataFrame, batch_id: int) -> None:
        accepted = validate_replay(batch).filter("replay_reason IS NULL")
        requests = to_replay_request(accepted, prefix, BATCH)
        writer = requests.withColumnRenamed(BATCH, "batch").write.mode("overwrite").partitionBy("batch")
        writer.option("partitionOverwriteMode", "dynamic").json(target)

    writer = stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()
