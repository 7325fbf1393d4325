"""Imports every module of plans, so that the registry is full."""

from seqloom.plans import checks, evaluate, geometry, learner, match, rules, signal, sources, streaming, verdict  # noqa: F401
from seqloom.plans.registry import QUERIES, SQL  # noqa: F401
