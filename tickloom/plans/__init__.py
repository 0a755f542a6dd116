"""The named queries: importing this registers them."""

from tickloom.plans import extras, feeds, market, more, reference  # noqa: F401
from tickloom.plans.catalog import QUERIES, SQL  # noqa: F401
