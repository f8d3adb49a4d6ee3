"""All registered queries."""

from promptledger.plans import aggregates, ingest, joins, listings, scalars, streams, windows  # noqa: F401
from promptledger.plans.registry import ORACLES, QUERIES  # noqa: F401
