"""The engine's own queries and the SQL that each must agree with."""

from mensura.plans import cascade, checks, classify, context, control, domain, drawing, extra, kernels, places, records, scalar, space
from mensura.plans.registry import QUERIES, SQL

FLAGSHIP = "agg1_layer_takeoff_index"
__all__ = ["FLAGSHIP", "QUERIES", "SQL", "cascade", "checks", "classify", "context", "control", "domain", "drawing", "extra", "kernels", "places", "records", "scalar", "space"]
