"""Every query of the engine by name, and the DuckDB SQL that gives the same rows."""

from .plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
