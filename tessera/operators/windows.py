"""Window specifications from groups, order and frame."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def spec(groups: list[Column], order: list[Column], frame: tuple[int | None, int | None] | None, kind: str = "user", ordered: bool = False) -> WindowSpec:
    """Rows of a frame: 0 is the current row, negative before it, positive after, None unbounded.

    kind: 'user' takes the given frame, 'none' leaves it out (ranks have none), 'running' is from the start to here.
    A function that needs an order gets a constant one, whose ties fall in any order."""
    w = Window.partitionBy(*groups)
    frame = {"user": frame, "none": None, "running": (None, 0)}[kind]
    if order:
        w = w.orderBy(*order)
    elif ordered or frame is not None:
        w = w.orderBy(F.lit(1))
    if frame is not None:
        start, end = frame
        w = w.rowsBetween(Window.unboundedPreceding if start is None else start, Window.unboundedFollowing if end is None else end)
    return w


def frame_of(x) -> tuple[int | None, int | None]:
    """A frame as verbs take it: a pair, or one number from which it runs to the end."""
    return (x, None) if isinstance(x, int) else tuple(x)
