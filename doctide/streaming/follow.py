"""Structured Streaming: following versioned documents, circuit breakers and debounced bursts, each with state per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from doctide.operators.sequences import Breaker


def follow_latest(stream: DataFrame) -> DataFrame:
    """(key, epoch, rev, arrival) whenever a document moves on; stream: (key long, epoch long, rev long, arrival long).

    Another epoch replaces what is held, the same epoch only by a higher revision.  Lateness is decided by revision alone,
    so there is no watermark and one row of state a key.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        for r in pd.concat(list(batches)).sort_values("arrival").itertuples():
            if held is None or r.epoch != held[0] or r.rev > held[1]:
                held = (int(r.epoch), int(r.rev), int(r.arrival))
        if not state.exists or held != tuple(state.get):
            state.update(held)
            yield pd.DataFrame([(key[0], *held)], columns=["key", "epoch", "rev", "arrival"])

    out, kept = "key long, epoch long, rev long, arrival long", "epoch long, rev long, arrival long"
    return stream.groupBy("key").applyInPandasWithState(fold, out, kept, "update", GroupStateTimeout.NoTimeout)


def breaker_stream(stream: DataFrame) -> DataFrame:
    """(service, t, state) after each outcome; stream: (service long, t long, failed boolean)."""

    def walk(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        breaker = Breaker()
        if state.exists:
            outcomes, until = state.get
            breaker.outcomes, breaker.until = [x == "1" for x in outcomes], None if until < 0 else until
        pdf = pd.concat(list(batches)).sort_values("t")
        states = [breaker.step(int(t), bool(f)) for t, f in zip(pdf["t"], pdf["failed"], strict=True)]
        state.update(("".join("1" if x else "0" for x in breaker.outcomes), -1 if breaker.until is None else breaker.until))
        yield pd.DataFrame({"service": [key[0]] * len(pdf), "t": pdf["t"].tolist(), "state": states})

    return stream.groupBy("service").applyInPandasWithState(walk, "service long, t long, state string", "outcomes string, until long", "append", GroupStateTimeout.NoTimeout)


def bursts(stream: DataFrame, ts: str, key: str, delay: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Bursts of events that follow each other within `delay`, handed over once no earlier event can come: start, end, n, items."""
    window = F.session_window(ts, delay)
    got = stream.withWatermark(ts, late).groupBy(key, window).agg(F.count("*").alias("n"), F.collect_set("item").alias("items"))
    return got.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", F.array_sort("items").alias("items"))


def upsert_sink(path: str):
    """A foreachBatch function that keeps the last row of each key of a batch and adds it to the table at `path`.

    Batches carry their number, so that a batch written again after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("key").agg(F.max_by(F.struct(*batch.columns), "arrival").alias("r")).select("r.*")
        last.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
