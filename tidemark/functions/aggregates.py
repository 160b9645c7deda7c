"""The dialect's functions: five aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")


def aggregate(name: str, args: list[Column], names: list[str], distinct: bool, star: bool) -> Column:
    """name over columns; names are the columns' own names, for forms only SQL text has."""
    match name:
        case "COUNT":
            return F.count("*") if star else F.count_distinct(*args) if distinct else F.count(args[0])
        case "SUM":
            return F.sum_distinct(args[0]) if distinct else F.sum(args[0])
        case "AVG":
            return F.expr(f"avg(DISTINCT `{names[0]}`)") if distinct else F.avg(args[0])
        case "MIN":
            return F.min(args[0])
        case _:
            return F.max(args[0])
