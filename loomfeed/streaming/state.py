"""Structured Streaming forms of the seen set and the retry queue; each equals its batch twin after the last batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.values import backoff_seconds
from ..session import fresh_path


def seen_dedup(stream: DataFrame, keys: list[str], ts: str | None = None, delay: str | None = None) -> DataFrame:
    """The first row of each key. With a delay the state of old keys is dropped; without it all keys are remembered."""
    if ts and delay:
        return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def retry_queue(outcomes: DataFrame, key: str) -> DataFrame:
    """key, attempts, due: after each batch the keys whose last outcome is a failure, with the backoff of consecutive failures.

    outcomes: key, at (epoch seconds), ok. Due is null for a key that succeeded.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, attempts = state.get if state.exists else (-1, 0)
        # a key's rows come in several frames in no order: nine bytes of each are kept; at one time failures come first
        parts = [(f["at"].to_numpy("int64"), f["ok"].to_numpy("bool")) for f in frames]
        at, ok = np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
        if len(at):
            order = np.lexsort((ok, at))
            good = np.flatnonzero(ok[order])
            last, attempts = int(at.max()), len(at) - 1 - int(good[-1]) if len(good) else attempts + len(at)
        state.update((last, attempts))
        due = last + min(21600, 60 * 2 ** min(attempts - 1, 8)) if attempts else None
        yield pd.DataFrame({key: [k[0]], "attempts": [attempts], "due": pd.array([due], "Int64")})

    kind = outcomes.schema[key].dataType.simpleString()
    return outcomes.select(key, "at", "ok").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, attempts long, due long", "last long, attempts long", "update", GroupStateTimeout.NoTimeout)


def retry_queue_batch(outcomes: DataFrame, key: str) -> DataFrame:
    """The same over a table: failures since the last success."""
    a = outcomes.groupBy(key).agg(F.max("at").alias("_last"), F.coalesce(F.max(F.when(F.col("ok"), F.col("at"))), F.lit(-1)).alias("_ok_at"))
    late = outcomes.where("NOT ok").select(key, "at").join(a.select(key, "_ok_at"), key).where("at > _ok_at").groupBy(key).agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0).cast("long"))
    return a.join(late, key, "left").select(key, n.alias("attempts"), F.when(n > 0, F.col("_last") + backoff_seconds(n)).alias("due"))


def run_available(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; sink must be idempotent per batch id."""
    q = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def drained(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what is there, a folder of Parquet per batch, so that a repeated batch replaces itself; all rows put out, with their batch."""
    spark, out = df.sparkSession, fresh_path(df.sparkSession, name)
    run_available(df, f"{out}-state", lambda rows, i: rows.write.mode("overwrite").parquet(f"{out}/batch={i}"), mode)
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, batch long").parquet(out)


def latest(rows: DataFrame, key: str) -> DataFrame:
    """The last row put out for each key."""
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("_l")).select(key, "_l.*")
