"""All registered queries and their SQL."""

from framelake.plans import group_a, group_b, group_c, group_d, group_g, group_h, group_i, group_j  # noqa: F401
from framelake.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
