"""Named queries over the given tables, with the SQL that states what each must return."""

from fieldcal.catalog.registry import ORACLE, QUERIES

# Importing the modules registers their queries.
from fieldcal.catalog import analysis, experiments, fits, pipelines, shaping, significance  # noqa: F401, E402

__all__ = ["ORACLE", "QUERIES"]
