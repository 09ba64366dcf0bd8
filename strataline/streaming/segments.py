"""Continuous forms of the media operators (an extension: the batch operators are the contract).

Events arrive late and out of order; a watermark bounds how long state is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strataline.operators.media import MARK_EVERY_S


def windowed_counts(events: DataFrame, time: str = "ts", window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events per tumbling window and type."""
    own = events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late)
    return own.groupBy(F.window("at", window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n")


def marked_cues(cues: DataFrame, every: float = MARK_EVERY_S) -> DataFrame:
    """(source_id, start_s, text, marked) of cues (source_id, start_s, text): at most one mark each ``every`` seconds, across batches."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0.0
        for batch in batches:
            batch = batch.sort_values("start_s", kind="stable")
            marks = []
            for at in batch["start_s"]:
                marks.append(at - last >= every)
                last = at if marks[-1] else last
            yield pd.DataFrame({"source_id": key[0], "start_s": batch["start_s"], "text": batch["text"], "marked": marks})
        state.update((float(last),))

    schema = "source_id long, start_s double, text string, marked boolean"
    return cues.groupBy("source_id").applyInPandasWithState(step, schema, "last double", "append", GroupStateTimeout.NoTimeout)


def new_segments(stream: DataFrame, known: str, out: str, checkpoint: str):
    """Writes segments whose (origin, key) the table at ``known`` lacks; each micro-batch is one anti-join."""

    def write(batch: DataFrame, _: int) -> None:
        old = batch.sparkSession.read.parquet(known).select("origin", "key")
        batch.join(old, ["origin", "key"], "left_anti").write.mode("append").parquet(out)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
