"""Near-real-time twins of the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from hazlens import session
from hazlens.functions.lexicon import Entry
from hazlens.operators import tagging
from hazlens.operators.classify import Ensemble


def events(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """An events table as a stream; its times are made instants, which watermarks need."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, late: str = "1 day", width: str = "1 day", slide: str | None = None, by: str = "event_type") -> DataFrame:
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = stream.withWatermark("ts", late).groupBy(window.alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), by, "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 day", by: str = "user_id") -> DataFrame:
    out = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), by, "n")


def deduplicated(stream: DataFrame, key: list[str], late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def tagged(stream: DataFrame, lexicon: list[Entry], key: str, text: str) -> DataFrame:
    return tagging.tags(stream, lexicon, key, text)


def scored(stream: DataFrame, model: Ensemble, threshold: float = 0.5) -> DataFrame:
    """Each report with its score as it arrives, by the same stages as in batch."""
    return model.score(stream, threshold)


def met_within(first: DataFrame, second: DataFrame, by: str, within: str, late: str = "1 day") -> DataFrame:
    """(by, first_id, second_id) of events of two streams where the second follows the first of its group within a time.

    Both have event_id, ts and ``by``. Watermarks on both sides let the state of old rows go.
    """
    a = first.withWatermark("ts", late).select(F.col(by).alias("__a"), F.col("ts").alias("__at"), F.col("event_id").alias("first_id"))
    b = second.withWatermark("ts", late).select(F.col(by).alias("__b"), F.col("ts").alias("__bt"), F.col("event_id").alias("second_id"))
    met = a.join(b, (F.col("__a") == F.col("__b")) & (F.col("__bt") > F.col("__at")) & (F.col("__bt") <= F.col("__at") + F.expr(f"INTERVAL {within}")))
    return met.select(F.col("__a").alias(by), "first_id", "second_id")


class RepeatAlert(StatefulProcessor):
    """An alert each time a key's count passes a multiple of ``every``."""

    def __init__(self, every: int) -> None:
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        before = self.count.get()[0] if self.count.exists() else 0
        now = before + sum(len(r) for r in rows)
        self.count.update((now,))
        if now // self.every > before // self.every:
            yield pd.DataFrame({"key": [key[0]], "n": [now]})

    def close(self) -> None:
        """Nothing is held."""


def repeat_alerts(stream: DataFrame, by: str, every: int) -> DataFrame:
    """(key, n) whenever a key's count passes a multiple of ``every``. Needs the RocksDB state store.

    :func:`hazlens.session.build` sets it; a session from elsewhere that names none is given it here.
    """
    conf = stream.sparkSession.conf
    if conf.get("spark.sql.streaming.stateStore.providerClass") != session.ROCKSDB:
        conf.set("spark.sql.streaming.stateStore.providerClass", session.ROCKSDB)
    return stream.groupBy(by).transformWithStateInPandas(RepeatAlert(every), outputStructType=f"key {dict(stream.dtypes)[by]}, n long", outputMode="Update", timeMode="None")


def upsert(path: str, key: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that keeps the newest row of each key, in one folder a batch.

    A batch that is run again writes the same folder again, so results are exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(*key).agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")
        newest.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def current(spark: SparkSession, path: str, key: list[str], order: str) -> DataFrame:
    """The newest row of each key over all batches that :func:`upsert` wrote."""
    return spark.read.parquet(path).groupBy(*key).agg(F.max_by(F.struct("*"), F.struct(order, "batch")).alias("r")).select("r.*").drop("batch")


def partial_counts(path: str, by: list[str], late: str = "1 day", width: str = "1 day") -> Callable[[DataFrame, int], None]:
    """A batch writer of counts by window that loses no late row: each batch's own counts go to a folder of their own.

    A row is late if its window had ended ``late`` or more before the newest time of the batches before; what a window with a watermark
    would drop is counted and marked here. No state is held, and a batch that is run again writes the same folder again. Rows
    without a time are counted under a null window and are never late.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # one row a batch before this one
        newest = spark.read.schema("batch int, newest timestamp").parquet(f"{path}/newest").where(F.col("batch") < number) if number else None
        seen = newest.agg(F.max("newest")).first()[0] if newest is not None else None
        window = F.window("ts", width)
        counted = batch.where("ts is not null").groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"))
        counted = counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("__end"), *by, "n")
        untimed = batch.where("ts is null").groupBy(*by).agg(F.count("*").alias("n"))
        behind = F.coalesce(F.col("__end") + F.expr(f"INTERVAL {late}") <= F.lit(seen), F.lit(False))
        rows = counted.unionByName(untimed, allowMissingColumns=True).withColumn("late", F.when(behind, F.col("n")).otherwise(0)).drop("__end")
        rows.write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
        batch.agg(F.max("ts").alias("newest")).select(F.lit(number).alias("batch"), "newest").write.mode("overwrite").parquet(f"{path}/newest/number={number}")

    return write


def amended_counts(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """(window_start, by, n, late) over all batches that :func:`partial_counts` wrote: every row counted once, and how many of them came late."""
    parts = spark.read.parquet(f"{path}/counts")
    return parts.groupBy("window_start", *by).agg(F.sum("n").alias("n"), F.sum("late").alias("late"))


def each_batch(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], trigger: dict | None = None) -> StreamingQuery:
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()


def start(stream: DataFrame, checkpoint: str, path: str, mode: str = "append", trigger: dict | None = None, fmt: str = "parquet") -> StreamingQuery:
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).format(fmt).start(path)


def run_now(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that is there now, worked through as a stream and read back from ``folder``.

    In complete mode the rows are those after the last batch, with the windows that are still open.
    """
    if mode == "complete":
        # there are rows even if no batch runs; a batch that is run again writes the same
        stream.sparkSession.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/rows")
        whole = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        whole.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/rows")).start().awaitTermination()
        return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
    query = start(stream, f"{folder}/checkpoint", f"{folder}/rows", mode) if mode == "append" else (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows" if mode == "append" else f"{folder}/rows/*")
