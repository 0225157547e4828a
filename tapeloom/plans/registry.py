"""Every query of the library by name, with its SQL where SQL can express it."""

from __future__ import annotations

from tapeloom.plans import attribution, book, chains, decisions, estimators, flow, inference, models, more, panels, patterns, research, scans, streams, vol  # noqa: F401  they register their queries
from tapeloom.plans.base import QUERIES, SQL  # noqa: F401

FLAGSHIP = "asof_effective_spread"
