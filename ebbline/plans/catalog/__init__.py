"""All named queries. Importing the topic modules fills the registry."""

from ebbline.plans.catalog.registry import ORACLES, QUERIES
from ebbline.plans.catalog import (  # noqa: F401  (importing registers the queries)
    cleaning,
    evaluation,
    facts,
    fixed,
    modelling,
    profiling,
    statistics,
)

__all__ = ["ORACLES", "QUERIES"]
