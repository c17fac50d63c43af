"""The library's queries over the driver's tables, registered by name."""

from . import catalogs, checks, features, files, packs, scores, streams  # noqa: F401  they register themselves
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
