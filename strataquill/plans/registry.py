"""All core queries by name."""

from __future__ import annotations

from . import documents, extras, pipelines, platform, search, streams
from .base import ORACLE_SQL, QUERIES

flagship = search.flagship
MODULES = (documents, platform, search, streams, pipelines, extras)
__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
