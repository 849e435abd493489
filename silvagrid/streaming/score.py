"""Scoring of a streaming frame: prediction is a stateless projection, so a stream needs no more."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from silvagrid.plans.forest import ForestModel, predict


def score_stream(stream: DataFrame, model: ForestModel, features: Sequence[Column | str] | str, sink: str, checkpoint: str,
                 trigger: dict | None = None) -> StreamingQuery:
    """Append predictions of a trained model to a parquet sink as new files arrive."""
    scored = predict(stream, model, features)
    writer = scored.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
