"""Session settings the transforms rely on."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Needed by the stateful stream operator; harmless for batch jobs.
ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(
    app_name: str = "ledgerwatch",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **extra: str,
) -> SparkSession:
    """Session with UTC time, AQE and skew handling on.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: spark-submit names the
    master, and AQE coalesces from whatever initial partition count the cluster configures.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        **RUNTIME_SETTINGS,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER,
        # Recording a call site for every column expression doubles plan-building time.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(extra)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare_session(spark: SparkSession) -> SparkSession:
    """Settings a given session must have: UTC, as the data model keeps every timestamp in
    UTC, and a method size the JVM still compiles (larger generated methods are interpreted,
    which costs more than leaving whole-stage generation for that stage)."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    return spark


@contextmanager
def keyed_state_settings(spark: SparkSession, event_time: bool = False) -> Iterator[None]:
    """Settings a query with keyed state must be started under (a query keeps the settings
    it was started with).

    Several state maps need the RocksDB store. State with a wall-clock life would also ask
    for empty micro-batches for ever, so that a run over the available data would not end;
    entries past their life are dropped with the next data instead. Event-time state has
    no wall-clock life, and needs the empty micro-batch after the last data for its timers.
    """
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER,
        "spark.sql.streaming.noDataMicroBatches.enabled": str(event_time).lower(),
    }
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder: the cluster's ``spark.checkpoint.dir`` when it names one.

    Only a session without that setting (tests, a laptop) falls back to a temporary folder,
    and never on a real cluster, where executors could not see it.
    """
    context = spark.sparkContext
    existing = context.getCheckpointDir()
    if existing:
        return existing
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="spark-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package: Python functions in a plan are found there by name.

    Once per application. The archive goes out by Spark's own file distribution.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="spark-package-"), name)
    context.addPyFile(shutil.make_archive(base, "zip", root, name))
    _SHIPPED.add(context.applicationId)
