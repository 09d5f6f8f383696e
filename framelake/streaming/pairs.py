"""The streaming twin of frame references: (previous, current) pairs of each sequence from frames that arrive in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from framelake.shared import own_folder

OUT = "seq_id long, frame_no long, pos long, prev_pos long, is_first boolean, late boolean"
#: The state store that processors with timers need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class LastFrame(StatefulProcessor):
    """Keeps a sequence's last frame, and a timer that removes it when the watermark has gone `ttl` seconds past its latest frame."""

    def __init__(self, ttl: float) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "frame_no long, pos long, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last_no, last_pos, until = self.last.get() if self.last.exists() else (-1, -1, -1)
        found, latest = [], until
        for frame in pd.concat(list(rows)).sort_values(["frame_no", "pos"]).itertuples():
            late = frame.frame_no <= last_no
            found.append((key[0], frame.frame_no, frame.pos, None if late or last_no < 0 else last_pos, last_no < 0, late))
            latest = max(latest, int(frame.ts.timestamp() * 1000 + self.ttl * 1000))
            if not late:
                last_no, last_pos = frame.frame_no, frame.pos
        if latest != until:
            if until >= 0:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(latest)
        self.last.update((last_no, last_pos, latest))
        yield pd.DataFrame(found, columns=["seq_id", "frame_no", "pos", "prev_pos", "is_first", "late"]).astype({"prev_pos": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_frame_pairs(frames: DataFrame, ttl: float = 86_400.0, delay: str = "1 hour") -> DataFrame:
    """A streaming DataFrame (seq_id, frame_no, pos, ts) to its pairs. The frames of a sequence in one micro-batch are sorted; later batches are
    taken to hold later frames, and a frame that comes after a later one is marked late, without a partner. A sequence that gets no frame
    until the watermark, `delay` behind the latest time seen, is `ttl` seconds past its last is forgotten: a further frame is a first one again. Frames
    older than the watermark are dropped by Spark, which counts them. A micro-batch bounds what a task holds of one sequence. Needs the state
    store of PROVIDER."""
    timed = frames.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy("seq_id").transformWithStateInPandas(LastFrame(ttl), outputStructType=OUT, outputMode="append", timeMode="EventTime")


def pairs_of_table(spark: SparkSession, frames: DataFrame, slices: int = 3, ttl: float = 1e9, delay: str = "1 hour") -> DataFrame:
    """Run the stream over a table (seq_id, frame_no, pos, ts): slices of frames arrive one after the other by their time, in as many files as
    their tasks write, the query takes what is new each time, its state living on in its checkpoint, and the pairs are read back."""
    at = own_folder(spark, "stream")
    rows = frames.select("seq_id", F.col("frame_no").cast("long").alias("frame_no"), "pos", F.col("ts").cast("timestamp").alias("ts"))
    cuts = rows.agg(F.percentile_approx("ts", [i / slices for i in range(1, slices)], 1_000).alias("cuts")).first()["cuts"] or []
    place = sum((F.when(F.col("ts") > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    before = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    try:
        for i in range(slices):
            rows.where(place == i).write.mode("append").parquet(f"{at}/in")
            pairs = stream_frame_pairs(spark.readStream.schema(rows.schema).parquet(f"{at}/in"), ttl, delay)
            sink = pairs.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state")
            sink.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER[0], before)
    return spark.read.schema(OUT).parquet(f"{at}/out")
