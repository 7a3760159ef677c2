"""Streams: documents that land in a folder become chunks, and events pass a stateful limiter."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import OVERLAP, SIZE, chunk_documents
from ..operators.limits import LIMIT, WINDOW_SECONDS


def stream_chunks(spark: SparkSession, landing: str, schema: str, sink: str, checkpoint: str, method: str = "By Sentence", size: int = SIZE, overlap: int = OVERLAP) -> StreamingQuery:
    """Parquet documents (doc_id, text) landing in a folder -> chunk rows in a parquet sink, exactly once."""
    docs = spark.readStream.schema(schema).parquet(landing)
    return chunk_documents(docs, method, size, overlap).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_limiter(events: DataFrame, key: str, ts: str, limit: int = LIMIT, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """(key, ts) -> key, ts, accepted. The state of a key is its accepted times within the window: at most ``limit``."""

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        frames = [b for b in batches]
        rows = pd.concat(frames).sort_values("ts")
        verdicts = []
        for t in rows["ts"].astype("int64"):
            kept = [k for k in kept if t - k < seconds * 1_000_000]
            verdicts.append(len(kept) < limit)
            if verdicts[-1]:
                kept.append(int(t))
        state.update((kept,))
        yield pd.DataFrame({key: group[0], "ts": rows["ts"].to_numpy(), "accepted": verdicts})

    rows = events.selectExpr(f"cast({key} as long) as {key}", f"unix_micros(cast({ts} as timestamp)) as ts")
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} long, ts long, accepted boolean", "kept array<long>", "append", "NoTimeout")
