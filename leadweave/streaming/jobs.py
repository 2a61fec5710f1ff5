"""The job log and the export as streams. What must be remembered is keyed state: one entry a job, one entry a company key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.dedup import greedy_distinct
from ..operators.jobs import latest_states
from ..operators.lineage import cut_lineage

#: The state store that holds more keys than memory.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Event files as they arrive."""
    return spark.readStream.schema(schema).parquet(folder)


def until_idle(query: StreamingQuery) -> None:
    """Waits until all that has arrived is worked off, and stops the query; it goes on from its checkpoint when started again."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def _started(spark: SparkSession, frame: DataFrame, mode: str, step: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, once: bool = False) -> StreamingQuery:
    """A query takes the session's settings when it starts; the session gets its own back."""
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        writer = frame.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every) if every else writer).start()
    finally:
        if before is None:
            spark.conf.unset(STORE[0])
        else:
            spark.conf.set(STORE[0], before)


def follow_jobs(events: DataFrame, table: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keeps the latest state of each job: state is one row a job, and each batch adds the jobs that it changed to the table.

    A batch that is run again replaces its own folder. Without ``every``, batches follow one another at once.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return _started(events.sparkSession, latest_states(events), "update", step, checkpoint, every)


def current_jobs(spark: SparkSession, table: str) -> DataFrame:
    """One row a job: its last change."""
    changes = spark.read.parquet(table)
    row = F.struct(*[F.col(c) for c in changes.columns if c != "batch"])
    return changes.groupBy("job_id").agg(F.max_by(row, "batch").alias("_last")).select("_last.*")


class TakenKeys(StatefulProcessor):
    """State: the first batch that exported the key. A batch that asks gets an answer if an earlier one did."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", StructType([StructField("batch", LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803 (Spark's names)
        known = self.taken.get()[0] if self.taken.exists() else None
        first, asked = known, set()
        for row in rows:
            if row["asked"]:
                asked.add(row["batch"])
            elif first is None or row["batch"] < first:
                first = row["batch"]
        if first != known:
            self.taken.update((first,))
        for batch in sorted(asked):
            if first is not None and first < batch:
                yield Row(key=key[0], batch=batch)

    def close(self) -> None:
        pass


KEYS = "key string, batch long"


def _answered(spark: SparkSession, export: str, checkpoint: str) -> None:
    """Works off the keys asked for and exported since the last time; keys that an earlier batch took go to ``{export}/known``."""
    told = [spark.readStream.schema(KEYS).parquet(f"{export}/{name}/to=*").select("key", "batch", F.lit(name == "asked").alias("asked")) for name in ("asked", "keys")]
    shape = StructType([StructField("key", StringType()), StructField("batch", LongType())])
    answers = told[0].unionByName(told[1]).groupBy("key").transformWithState(TakenKeys(), shape, "Append", "None")

    def step(known: DataFrame, number: int) -> None:
        known.withColumn("to", F.col("batch")).write.mode("append").partitionBy("to").parquet(f"{export}/known")

    _started(spark, answers, "append", step, f"{checkpoint}/taken", once=True).awaitTermination()


def append_new(companies: DataFrame, export: str, checkpoint: str, keyed: Callable[[DataFrame], DataFrame], every: str | None = None) -> StreamingQuery:
    """Each batch: distinct companies that no earlier batch exported are appended to ``{export}/rows``.

    ``keyed`` adds ``seq``, unique in a batch, and ``keys``. A batch first drops its own duplicates, whose rows so never reach
    Python; the keys of what is left, each held by one row, meet their entries in a state store, filled from the keys that
    batches export. So a batch costs the same however much has been exported. Rows without keys are dropped.

    A batch that is run again replaces its rows; its keys are told and asked for once more, which changes nothing: a key that it
    took itself does not bar it.
    """
    spark = companies.sparkSession
    for name in ("asked", "keys", "known"):
        spark.createDataFrame([], KEYS).write.mode("append").parquet(f"{export}/{name}/to=-1")

    def step(batch: DataFrame, number: int) -> None:
        first = cut_lineage(greedy_distinct(keyed(batch).withColumn("keys", F.array_distinct("keys"))))

        def tell(rows: DataFrame, name: str) -> DataFrame:
            keys = rows.select("seq", F.explode("keys").alias("key")).filter("key IS NOT NULL")
            keys.select("key", F.lit(number).cast("long").alias("batch")).write.mode("append").parquet(f"{export}/{name}/to={number}")
            return keys

        asked = tell(first, "asked")
        _answered(spark, export, checkpoint)
        known = spark.read.schema(KEYS).parquet(f"{export}/known/to={{-1,{number}}}").select("key")
        new = cut_lineage(first.join(asked.join(known, "key", "left_semi").select("seq"), "seq", "left_anti"))
        new.write.mode("overwrite").parquet(f"{export}/rows/batch={number}")
        tell(new, "keys")

    return _started(spark, companies, "append", step, checkpoint, every)


def exported(spark: SparkSession, export: str) -> DataFrame:
    """All companies exported so far, with their keys and batch."""
    return spark.read.parquet(f"{export}/rows")


__all__ = ["append_new", "current_jobs", "exported", "follow_jobs", "read_events", "until_idle"]
