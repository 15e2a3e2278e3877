"""Queries of the engine, each with SQL that gives the same rows where SQL can."""

from . import registry
from . import texts, retrieval, evaluation, states, addresses, flows, volumes, records, items, extension, protocols, balanced, encoders  # noqa: F401

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
