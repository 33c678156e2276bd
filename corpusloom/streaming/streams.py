"""Streams: stage metrics by event time, documents as they arrive, and a session's release kept as state."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.functions.text import NAMED_RELEASE
from corpusloom.operators.dialog import CLEAR


def window_metrics(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """event_type, start, n, total for each window of event time; events later than `late` are left out. Streams and tables alike."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


def session_metrics(events: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """user_id, start, end, n of each run of events without a longer gap."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n")


def ingest(spark: SparkSession, source: str, schema: str, checkpoint: str, step: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Files of `source` as they come, each batch to step(documents, batch_id), exactly once by the checkpoint."""
    stream = spark.readStream.schema(schema).parquet(source)
    w = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def sticky_release(turns: DataFrame) -> DataFrame:
    """turns(session_id, turn, content) of a stream with the release each question is filtered by; a session keeps its last one as state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = state.get[0] if state.exists else None
        rows = []
        for r in pd.concat(list(batches)).sort_values("turn").itertuples():
            years = list(dict.fromkeys(re.findall(NAMED_RELEASE, r.content or "")))
            if re.search(CLEAR, r.content or ""):
                kept, used = None, None
            elif len(years) == 1:
                kept = used = int(years[0])
            else:
                used = None if years else kept
            rows.append((key[0], r.turn, used))
        state.update((kept,))
        yield pd.DataFrame(rows, columns=["session_id", "turn", "release"]).astype({"release": "Int32"})

    return turns.groupBy("session_id").applyInPandasWithState(step, "session_id string, turn long, release int", "kept int", "append", GroupStateTimeout.NoTimeout)
