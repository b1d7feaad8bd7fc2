"""Importing this module registers every query."""

from catalog import comparison, edges, evaluation, modelling, statistics, structure, systems, tables  # noqa: F401
