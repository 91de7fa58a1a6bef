"""Every operator as a query over the given tables, with its check."""

from sheafline.plans.catalog import (  # noqa: F401
    aggregates,
    chunking,
    eventlog,
    extraction,
    projections,
    search,
    sources,
    streams,
    tables,
)
from sheafline.plans.registry import CHECKS, QUERIES  # noqa: F401
