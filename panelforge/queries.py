"""All registered queries but those of the optional subpackage."""

from __future__ import annotations

from .operators import queries as operators
from .operators import report_queries, source_queries  # noqa: F401  register their own
from .plans import dsl_queries

QUERIES = {**dsl_queries.QUERIES, **operators.QUERIES}
ORACLES = {**dsl_queries.ORACLES, **operators.ORACLES}
