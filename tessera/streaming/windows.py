"""Time windows of streams: an extension beside the verbs, which work on streaming DataFrames where Spark allows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import stated
from ..table import Tbl


def tumbling(t: Tbl, time: str, every: str, late: str | None = None, by: tuple[str, ...] = (), slide: str | None = None, **named) -> Tbl:
    """Aggregates for each window of time and group; rows later than `late` are dropped by the watermark of a stream."""
    df = t.df.withWatermark(time, late) if late else t.df
    ctx = t._ctx("summarize", df=df)
    window = F.window(time, every, slide) if slide else F.window(time, every)
    out = df.groupBy(window.alias("window"), *by).agg(*[stated(e).column(ctx).alias(k) for k, e in named.items()])
    cols = [F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, *named]
    return t._next("tumbling", out.select(*cols), groups=())
