"""All registered queries."""

from larder.plans import attempts, extras, labels, lookups, reading, risk, snapshots  # noqa: F401
from larder.plans.registry import QUERIES, SQL  # noqa: F401
