"""All queries and their SQL."""

from . import banks, blocks, catalogue, desk, extraction, keys, patterns, publishing, questions, sources, taxonomy, texts, upgrades, upkeep  # noqa: F401  their queries are added by import
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
