"""Query plans by topic; importing this registers them all."""

from koinea.plans import evaluation, lexical, relational
from koinea.plans.registry import ORACLES, QUERIES

flagship = lexical.cross_group_distance

__all__ = ["ORACLES", "QUERIES", "evaluation", "flagship", "lexical", "relational"]
