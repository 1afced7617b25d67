"""Switches of the library."""

from __future__ import annotations

#: Whether verbs that consume groups, window order and frame say so.
warn = False


def warnings(on: bool) -> None:
    """Turns the verbs' warnings on or off."""
    global warn
    warn = on


def set_sql_mode(mode: str) -> None:
    """The engine is Spark; another dialect cannot be chosen."""
    if mode.lower() != "spark":
        raise ValueError("queries run on Spark; read other engines' tables with jdbc, warehouse or attach")
