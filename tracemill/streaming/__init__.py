"""Refresh: new files are taken in as they appear, and after files changed."""

from tracemill.streaming.changes import Changes, read_changed, refresh_changed
from tracemill.streaming.refresh import new_files, read_rollup, refresh_rollup

__all__ = [
    "Changes",
    "new_files",
    "read_changed",
    "read_rollup",
    "refresh_changed",
    "refresh_rollup",
]
