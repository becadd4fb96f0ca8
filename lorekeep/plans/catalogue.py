"""All registered plans."""

from __future__ import annotations

from lorekeep.plans import access, aggregates, briefs, checks, facts, grants, index, inventory, joins, linking, load, ranking, reading, reports, resolution, results, retrieval, scalars, scans, segments, streams, wording  # noqa: F401
from lorekeep.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
