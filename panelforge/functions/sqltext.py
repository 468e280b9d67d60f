"""Shared SQL text of the oracles, and rounding that both engines do alike.

Sums of prices often end in an exact 5, where engines round apart.  ``rounded`` and the
SQL of ``exact_rounds`` cut at 0.5137 of the last digit instead, where no value lies.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CUT = 0.5137


def rounded(c: Column, digits: int) -> Column:
    return F.floor(c.cast("double") * F.lit(10.0**digits) + F.lit(CUT)).cast("double") / F.lit(10.0**digits)


def exact_rounds(sql: str) -> str:
    """Each ``round(x, d)`` of a statement in the form of ``rounded``."""
    at = sql.rfind("round(")
    while at >= 0:
        depth, end, comma = 1, at + 6, -1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if sql[end] == "," and depth == 1:
                comma = end
            end += 1
        x, d = sql[at + 6 : comma], sql[comma + 1 : end - 1].strip()
        sql = f"{sql[:at]}(floor(({x})::DOUBLE * 1e{d} + {CUT}) / 1e{d}){sql[end:]}"
        at = sql.rfind("round(", 0, at)
    return sql


PANEL = """a AS (SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS dt, l_suppkey AS sym,
 round(avg(l_extendedprice * (1 - l_discount)), 6) AS price, round(avg(l_quantity), 6) AS qty,
 sum(l_quantity) AS vol, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL),
p AS (SELECT *, CASE WHEN sym % 7 = 0 AND month(dt) % 5 = 0 THEN NULL ELSE price END AS x FROM a)"""


def rank_pct(x: str, by: str = "dt") -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE (rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {by}) END"
