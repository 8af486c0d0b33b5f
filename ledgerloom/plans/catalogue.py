"""All registered queries of the library, by importing the plan modules."""

from __future__ import annotations

from ledgerloom.plans import briefs, details, documents, graph, portfolio, retrieval, returns, state, workbook  # noqa: F401
from ledgerloom.plans.registry import ORACLES, QUERIES  # noqa: F401
