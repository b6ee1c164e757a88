"""All queries of the core by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import problems, reference

QUERIES = problems.QUERIES | reference.QUERIES
ORACLES: dict[str, str] = problems.ORACLES | reference.ORACLES
