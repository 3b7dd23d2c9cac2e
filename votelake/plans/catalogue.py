"""Every query of the library by name, and its DuckDB SQL."""

from __future__ import annotations

from . import cells, electorate, models, registry, stakes, territory, votes  # noqa: F401  modules register their queries
from .bindings import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
