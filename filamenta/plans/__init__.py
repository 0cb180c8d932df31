"""Registered queries of the fiber-network engine, and their SQL."""

from filamenta.plans import assembly, directors, files, fragments, measures, neighbourhoods, networks, particles, selections, shapes, steps, tiles, volumes  # noqa: F401
from filamenta.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
