"""Imports every query module, so that the registry is complete."""

from carelake.plans import (  # noqa: F401
    corpus_queries,
    dirty_queries,
    feedback_queries,
    metric_queries,
    model_queries,
    profile_queries,
    record_queries,
)
from carelake.plans.registry import REGISTRY  # noqa: F401
