"""All registered queries with their SQL, gathered from the query modules."""

from __future__ import annotations

from .plans import arbitrate, dedup, enrich, files, folds, gates, graph, identify, naming, policies, rules, search, state, taxonomy, texts
from .plans.base import ORACLE, QUERIES

MODULES = (arbitrate, dedup, enrich, files, folds, gates, graph, identify, naming, policies, rules, search, state, taxonomy, texts)
FLAGSHIP = "agg2_taxonomy_rollup"

__all__ = ["FLAGSHIP", "MODULES", "ORACLE", "QUERIES"]
