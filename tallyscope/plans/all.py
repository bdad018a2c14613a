"""Importing this module registers every query."""

from tallyscope.plans import catalogue, exports, merges, names, quality, reviews, rollups, series, shapes, sources, verdicts  # noqa: F401
from tallyscope.plans.base import ORACLES, QUERIES  # noqa: F401
