"""Named queries over the test tables and their SQL counterparts."""

from sparksci.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
