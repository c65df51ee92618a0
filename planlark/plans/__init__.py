"""Every query of the package, by name."""

from planlark.plans import geometry, packages, polygons, readiness, records, reports, retrieval, streams, tracker, units, verdicts  # noqa: F401
from planlark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
