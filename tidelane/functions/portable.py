"""SQL expressions that Spark and DuckDB read alike, and the few that each needs its own way.

Operators are built from these strings with ``selectExpr``; the same strings in common table
expressions give the SQL that results are held against. Windows are by ``symbol`` in order of
``h``, the hour (or day) number; rolling functions count non-null values like a minimum of periods.
"""

from __future__ import annotations

import re

ORDER = "PARTITION BY symbol ORDER BY h"


def over(rows: int) -> str:
    return f"({ORDER} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


def before(rows: int) -> str:
    return f"({ORDER} ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)"


def roll(function: str, x: str, rows: int, least: int | None = None) -> str:
    """Aggregate of the last ``rows`` rows; null with fewer than ``least`` (default ``rows``) values."""
    return f"CASE WHEN count({x}) OVER {over(rows)} >= {least or rows} THEN {function}({x}) OVER {over(rows)} END"


def lag(x: str, rows: int = 1) -> str:
    return f"lag({x}, {rows}) OVER ({ORDER})"


def lead(x: str, rows: int = 1) -> str:
    return f"lead({x}, {rows}) OVER ({ORDER})"


def ratio(n: str, d: str, eps: str = "1e-12") -> str:
    """n / d, null where |d| <= eps."""
    return f"CASE WHEN abs({d}) > {eps} THEN ({n}) / ({d}) END"


def change(x: str, rows: int = 1) -> str:
    return f"({x}) / nullif({lag(x, rows)}, 0) - 1"


def zscore(x: str, rows: int, least: int | None = None) -> str:
    """Distance from the mean of the ``rows`` rows before, in their population deviations; the deviation is never below a thousandth of the whole series' one (or 1e-11)."""
    w = before(rows)
    floor = f"greatest(1e-3 * abs(stddev_pop({x}) OVER (PARTITION BY symbol)), 1e-11)"
    return f"CASE WHEN count({x}) OVER {w} >= {least or rows} THEN ({x} - avg({x}) OVER {w}) / greatest(stddev_pop({x}) OVER {w}, {floor}) END"


def wilson(k: str, n: str, side: int) -> str:
    """End of the 95 % Wilson interval of k successes in n (side -1 or 1), within 0 and 1; null if n is 0."""
    z = 1.96
    p = f"(({k}) * 1.0 / nullif({n}, 0))"
    return f"least(1.0, greatest(0.0, ({p} + {z * z / 2} / ({n}) + {side * z} * sqrt({p} * (1 - {p}) / ({n}) + {z * z / 4} / (({n}) * ({n})))) / (1 + {z * z} / ({n}))))"


def average_rank(x: str, within: str = "") -> str:
    """Rank with ties at their mean."""
    part = f"PARTITION BY {within} " if within else ""
    same = f"PARTITION BY {within}, {x}" if within else f"PARTITION BY {x}"
    return f"(rank() OVER ({part}ORDER BY {x}) + (count(*) OVER ({same}) - 1) / 2.0)"


def digits(x: str) -> str:
    """A double to six places; exact halves, which engines' last bits would send either way, go up."""
    return f"round({x} + 1e-9, 6)"


_DECIMAL = re.compile(r"(?<![\w.])(\d+\.\d+)(?![\w.])")


def spark(sql: str) -> str:
    """Fill in what Spark writes its own way; numbers with a point are doubles."""
    sql = re.sub(r"PCT_\[(.*?); ?([\d.]+)\]", r"percentile(\1, \2)", sql)
    sql = re.sub(r"SEQ_\[(.*?); ?(.*?)\]", r"explode(sequence(\1, \2))", sql)
    sql = re.sub(r"EPOCH_\[(.*?)\]", r"unix_timestamp(CAST(\1 AS TIMESTAMP))", sql)
    return _DECIMAL.sub(r"\1D", sql).replace("ANTI_JOIN", "LEFT ANTI JOIN")


def duckdb(sql: str) -> str:
    """The same for DuckDB."""
    sql = re.sub(r"PCT_\[(.*?); ?([\d.]+)\]", r"quantile_cont(\1, \2)", sql)
    sql = re.sub(r"SEQ_\[(.*?); ?(.*?)\]", r"unnest(generate_series(\1, \2))", sql)
    sql = re.sub(r"EPOCH_\[(.*?)\]", r"CAST(floor(epoch(\1)) AS BIGINT)", sql)
    return _DECIMAL.sub(r"\1e0", sql).replace("ANTI_JOIN", "ANTI JOIN")
