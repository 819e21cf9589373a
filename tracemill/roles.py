"""Column roles of the long fact table.

Every operator takes a ``Roles`` value, so it runs on any table: a role maps a
meaning (time, value, market area, ...) to the name of a column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that results depend on.
SUPPORTED_SUFFIXES = (".parquet", ".csv")
ROOT_RUN = "."
ROOT_RUN_LABEL = "(data root)"


@dataclass(frozen=True)
class Roles:
    """Maps the meaning of a column to its name."""

    # The column names of the input files.
    time: str = "Datetime"
    value: str = "Value"
    run: str = "__run_key"
    source: str = "__source_file"
    ws: str = "WS"
    area: str = "BZ"
    prop: str = "Property"
    technology: str = "PEMMDB_TECHNOLOGY"
    unit: str = "Unit Name"
    sample: str = "Sample"
    scenario: str = "Scenario"

    @property
    def dimensions(self) -> tuple[str, ...]:
        """All role columns that describe a row, in selector-index order."""
        return (
            self.source,
            self.run,
            self.sample,
            self.area,
            self.ws,
            self.prop,
            self.technology,
            self.unit,
        )

    @property
    def plot_columns(self) -> tuple[str, ...]:
        """The columns read by default for plotting."""
        return (
            self.time,
            self.sample,
            self.area,
            self.ws,
            self.prop,
            self.technology,
            self.value,
            self.run,
            self.source,
        )


def col(name: str) -> Column:
    """Column by literal name: names may hold blanks or dots."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
