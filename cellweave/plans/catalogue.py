"""Every registered query and, where SQL can express it, its equivalent SQL."""

from __future__ import annotations

from cellweave.plans import distances, fleets, measures, scalars, space  # noqa: F401  they register their queries
from cellweave.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
