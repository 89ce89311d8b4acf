"""Operators composed into whole queries over the star-schema test tables."""

from deckloom.plans import cards, corpus, layout, lists, pixels, proofs, runs  # noqa: F401  (importing registers)
from deckloom.plans import streams  # noqa: F401  (after the rest: it reuses their SQL)
from deckloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
