"""Cutting lineage, as the rest of the library does it."""

from ..storage import checkpoint_dir, saved

__all__ = ["checkpoint_dir", "saved"]
