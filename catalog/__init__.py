"""Queries over the test tables, each with the SQL that gives the same rows.

``QUERIES`` maps a name to ``(spark, folder) -> DataFrame``; ``ORACLES`` maps the
same name to SQL over the same tables. Every module adds its own.
"""

from catalog import columns, curves, files, rollups, selectors, traces

MODULES = (traces, rollups, curves, selectors, columns, files)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
