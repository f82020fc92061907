"""The registered queries: operators applied to the driver's tables, each with the
equivalent SQL where SQL can say it."""

from sylva.workload import imagery, joins, missions, tables
from sylva.workload.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE", "imagery", "joins", "missions", "tables"]
