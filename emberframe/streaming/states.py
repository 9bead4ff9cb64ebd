"""State transitions with persistence over a stream.

Rows (entity, t, state) arrive in any order within the watermark; each entity's rows are taken in the order of t once the watermark has
passed them, so results equal the batch operator's for rows in time. Later rows are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

OUT = "entity string, t timestamp, from_state string, to_state string"
_STATE = T.StructType([T.StructField("committed", T.StringType()), T.StructField("candidate", T.StringType()), T.StructField("seen", T.IntegerType()), T.StructField("started", T.BooleanType()), T.StructField("waiting_t", T.ArrayType(T.TimestampType())), T.StructField("waiting_s", T.ArrayType(T.StringType()))])


def advance(committed, candidate, seen, started, rows, persistence):
    """One entity's state after rows in order, and its transitions (t, from, to)."""
    moves = []
    for t, s in rows:
        if not started:
            committed, candidate, seen, started = s, None, 0, True
        elif s == committed:
            candidate, seen = None, 0
        else:
            seen = seen + 1 if seen and s == candidate else 1
            candidate = s
            if seen >= persistence:
                moves.append((t, committed, s))
                committed, candidate, seen = s, None, 0
    return committed, candidate, seen, started, moves


def transitions(states: DataFrame, persistence: int = 1, *, delay: str = "1 hour") -> DataFrame:
    """entity, t, from_state, to_state of a stream of entity (string), t (timestamp), state (string)."""
    import pandas as pd

    def step(key, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        old = held.get if held.exists else (None, None, 0, False, [], [])
        waiting = list(zip(old[4] or [], old[5] or []))
        for pdf in batches:
            waiting += [(pd.Timestamp(t), s) for t, s in zip(pdf["t"], pdf["state"])]
        limit = pd.Timestamp(held.getCurrentWatermarkMs(), unit="ms")
        # rows that nothing earlier can precede any more
        waiting = sorted(((pd.Timestamp(t), s) for t, s in waiting), key=lambda x: x[0])
        ready = [x for x in waiting if x[0] <= limit]
        rest = waiting[len(ready) :]
        committed, candidate, seen, started, moves = advance(*old[:4], ready, persistence)
        held.update((committed, candidate, seen, started, [t.to_pydatetime() for t, _ in rest], [s for _, s in rest]))
        if rest:
            held.setTimeoutTimestamp(max(int(rest[0][0].timestamp() * 1000), held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], t, a, b) for t, a, b in moves], columns=["entity", "t", "from_state", "to_state"])

    own = states.select("entity", "t", "state").withWatermark("t", delay)
    return own.groupBy("entity").applyInPandasWithState(step, OUT, _STATE, "append", "EventTimeTimeout")


def counts(states: DataFrame, window: str = "10 minutes", *, delay: str = "1 hour") -> DataFrame:
    """start, state, n: rows of each state per window of a stream, once the watermark has passed it."""
    from pyspark.sql import functions as F

    return states.withWatermark("t", delay).groupBy(F.window("t", window).alias("w"), "state").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "state", "n")


def append(results: DataFrame, path: str, checkpoint: str):
    """Starts a query that adds a stream's per-step results to Parquet below path, each step once."""
    return results.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
