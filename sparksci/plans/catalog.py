"""Every registered query and its SQL counterpart."""

from sparksci.plans import cluster, definitions, filters, graph, hierarchy, morphology, numeric, planar, series, spatial, statistics
from sparksci.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cluster", "definitions", "filters", "graph", "hierarchy", "morphology", "numeric", "planar", "series", "spatial", "statistics"]
