"""The register of queries: name -> (function, equivalent SQL for DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def exact_rounds(sql: str) -> str:
    """The SQL with every ``round(x, n)`` done on decimals, as ``rounded`` does: doubles near a tie then round alike."""
    out, at = "", 0
    while (k := sql.find("round(", at)) >= 0:
        depth, comma, end = 1, -1, k + 6
        while depth:
            c = sql[end]
            depth += (c in "([") - (c in ")]")
            if c == "," and depth == 1:
                comma = end
            end += 1
        inner = sql[k + 6 : comma if comma > 0 else end - 1]
        if comma > 0:
            out += f"{sql[at:k]}CAST(round(CAST({exact_rounds(inner)} AS DECIMAL(28,12)), {sql[comma + 1 : end - 1].strip()}) AS DOUBLE)"
        else:
            out += f"{sql[at:k]}round({exact_rounds(inner)})"
        at = end
    return out + sql[at:]


def query(sql: str | None = None):
    """Registers a function under its own name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = exact_rounds(sql)
        return f

    return add
