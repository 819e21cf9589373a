"""Scenario time-series analytics as Spark DataFrame operators."""

from tracemill.roles import Roles

__all__ = ["Roles"]
