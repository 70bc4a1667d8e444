"""All registered queries by name."""

from __future__ import annotations

from caudal.plans import credit, ledger, modelling, quality, treasury
from caudal.plans.registry import Query

QUERIES: dict[str, Query] = {
    **ledger.QUERIES,
    **credit.QUERIES,
    **treasury.QUERIES,
    **modelling.QUERIES,
    **quality.QUERIES,
}
