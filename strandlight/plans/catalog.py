"""Imports every query module so that the registry is complete."""

from strandlight.plans import queries_binding, queries_genome, queries_recipes, queries_sources, queries_stats, queries_traces  # noqa: F401
from strandlight.plans.registry import ORACLE, QUERIES  # noqa: F401
