"""All query modules, imported for what they register."""

from evigraph.plans import claims, documents, edges, iterative, labels, layouts, logs, merges, papers, reports, vocabulary, workflow  # noqa: F401
from evigraph.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
