"""All registered queries."""

from supplygraph.plans import findings_catalog, functions_catalog, graph_catalog, sources_catalog  # noqa: F401
from supplygraph.plans.registry import ORACLES, QUERIES  # noqa: F401
