"""Queries of the engine; importing them registers them."""

from lumora.plans import catalogue, creators, ops, rules, text  # noqa: F401
from lumora.plans.registry import QUERIES, SQL  # noqa: F401
