"""Predictions over a stream of requests: an extension; each micro-batch is one batch prediction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kindred.operators.tables import scope
from kindred.plans.api import Engine


def predict_stream(requests: DataFrame, engine: Engine, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """requests: streaming (query_id, paragraph). sink gets each batch's predictions and its number, and
    must be idempotent by that number and take the rows before it returns: the batch's tables go then."""

    def run(batch: DataFrame, epoch: int) -> None:
        with scope():
            sink(engine.predict(batch), epoch)

    return requests.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(run).start()
