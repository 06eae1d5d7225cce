"""Imports every query module so the registry is complete."""

from ledgerlens.plans import (detect_queries, dirty_queries, feature_queries, io_queries, model_queries,  # noqa: F401
                             profile_queries)
from ledgerlens.plans.registry import ORACLES, QUERIES  # noqa: F401
