"""All registered queries and their SQL counterparts."""

from pairloom.plans import admissions, scores, stores, texts  # noqa: F401 - they register themselves
from pairloom.plans.common import ORACLES, QUERIES
from pairloom.plans.scores import flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
