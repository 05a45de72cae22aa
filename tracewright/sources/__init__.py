"""Readers and writers of event logs."""

from tracewright.sources.delimited import export_csv, read_csv_log, read_typed_log
from tracewright.sources.tables import load_log, open_log, save_log, save_tables
from tracewright.sources.xes import read_xes_log

__all__ = ["export_csv", "load_log", "open_log", "read_csv_log", "read_typed_log", "read_xes_log", "save_log", "save_tables"]
