"""Importing this module registers every query."""

from casegrid.plans import case_queries  # noqa: F401
from casegrid.plans import version_queries  # noqa: F401
from casegrid.plans import rule_queries  # noqa: F401
from casegrid.plans import text_queries  # noqa: F401
from casegrid.plans import gate_queries  # noqa: F401
from casegrid.plans import graph_queries  # noqa: F401
from casegrid.plans import stream_queries  # noqa: F401
from casegrid.plans import record_queries  # noqa: F401
