"""Tidy verbs over Spark DataFrames."""

from .functions.helpers import col, desc, lit, sql
from .operators.joins import closest
from .operators.selectors import across, cols, exclude, everything, span
from .options import set_sql_mode, warnings
from .session import session
from .sources.io import attach, connect, copy_to, db_table, drop_view, dt, jdbc, read, show_tables, update_con, warehouse
from .table import Tbl

__all__ = ["Tbl", "across", "attach", "closest", "col", "cols", "connect", "copy_to", "db_table", "desc", "drop_view", "dt", "everything", "exclude", "jdbc", "lit", "read", "session", "set_sql_mode", "show_tables", "span", "sql", "update_con", "warehouse", "warnings"]
