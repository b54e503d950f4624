"""All reference queries with their oracles."""

from . import history, matching, memory, operations, rendering, resumes, texts
from .catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "history", "matching", "memory", "operations", "rendering", "resumes", "texts"]
