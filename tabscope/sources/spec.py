"""What to profile."""
from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.patterns_fixed import DEFAULT_SOURCE_SYSTEM


@dataclass(frozen=True)
class SourceSpec:
    """A table to profile.

    ``path`` (optionally with ``format``) reads files directly; otherwise
    ``connection_type`` decides: ``catalog``/``databricks`` read
    ``database.table`` from the catalog, ``parquet``/``delta``/``csv`` read
    ``<data_root>/<type>/<table>``, ``duckdb`` reads the Delta folder of that name.
    ``options`` go to every reader.  ``schema`` (DDL) declares the columns of files, so that none is scanned to
    infer them; of a CSV the lines that don't fit are counted in the report's errors.
    """

    table: str
    name: str | None = None
    source_system: str = DEFAULT_SOURCE_SYSTEM
    database: str | None = None
    connection_type: str = "parquet"
    path: str | None = None
    format: str | None = None
    options: dict = field(default_factory=dict)
    schema: str | None = None

    @property
    def display_name(self) -> str:
        return self.name or self.table
