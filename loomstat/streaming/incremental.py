"""Incremental fits over streams: each micro-batch updates a small mergeable state on the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from loomstat.base import Model
from loomstat.errors import EmptyInput, UnsupportedOperation


def fit_stream(estimator, stream: DataFrame, checkpoint: str, on_batch: Callable[[Model, int], None] | None = None) -> Model:
    """Fit on all that a stream has now, batch after batch. The estimator, or its model, has update().

    A batch that is run again after a failure is skipped if its number was seen."""
    if not stream.isStreaming:
        raise UnsupportedOperation("a batch table is fitted with fit()")
    state: dict = {"model": None, "last": -1}

    def step(batch: DataFrame, number: int) -> None:
        if number <= state["last"] or batch.isEmpty():
            return
        model = state["model"]
        if model is None:
            model = estimator.fit(batch)
        elif hasattr(estimator, "update"):
            model = estimator.update(model, batch)
        elif hasattr(estimator, "partial_fit"):
            model = estimator.partial_fit(model, batch)
        elif hasattr(model, "update"):
            model = model.update(batch)
        else:
            raise UnsupportedOperation(f"{type(estimator).__name__} has no incremental fit")
        state.update(model=model, last=number)
        if on_batch:
            on_batch(model, number)

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if state["model"] is None:
        raise EmptyInput("the stream had no rows")
    return state["model"]


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of a key in tumbling windows with a watermark; the same on a stream and on a table."""
    from pyspark.sql import functions as F

    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
