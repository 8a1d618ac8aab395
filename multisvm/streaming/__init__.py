"""Streaming.

The reference has no streaming operator (no watermark, window or state). A
fitted model's ``transform`` is a stateless projection (``mapInArrow`` plus
column expressions), so it applies unchanged to a streaming DataFrame from
``spark.readStream``; :func:`score_stream` is that call, kept here so the
package layout has one place for stream use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def score_stream(model, stream: DataFrame, keep=None) -> DataFrame:
    """Score a streaming labelled frame with a fitted model (no state kept)."""
    if not stream.isStreaming:
        raise ValueError("expected a streaming DataFrame")
    return model.transform(stream, keep)


__all__ = ["score_stream"]
