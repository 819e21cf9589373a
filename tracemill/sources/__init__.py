"""Run folders and the files below them."""

from tracemill.sources.runs import (
    discover_files,
    list_runs,
    run_key,
    run_options,
    shared_folder,
    skipped_files,
)
from tracemill.sources.tables import load_files, load_runs, read_table, time_bounds_of_runs

__all__ = [
    "discover_files",
    "list_runs",
    "load_files",
    "load_runs",
    "read_table",
    "run_key",
    "run_options",
    "shared_folder",
    "skipped_files",
    "time_bounds_of_runs",
]
