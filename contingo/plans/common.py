"""Registry of named queries over the test tables, each paired with the
DuckDB oracle SQL that computes the same result from the same tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contingo.session import ensure_checkpoint_dir
from contingo.sources.io import read_table

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its
    oracle SQL (``None`` = not SQL-expressible, rows-only check)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def tbl(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared checkpoint directory (never machine-local
    on a cluster: the cluster names that directory)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/contingo-io/{tag}-{uuid.uuid4().hex}"


# Rounding applied to transcendental results in BOTH engines before the
# value hash (exp / log differ in the last bits between JVM and libm).  A
# p-value is compared by round(-log10 p, 4), so tiny ones are compared as well
# as large ones; a p of 0 (below the smallest double) stays null.
STAT_DIGITS = {"or_result": 6, "lower_ci": 6, "upper_ci": 6}
LOG_STATS = {"pvalue": 4, "pvalue_corrected": 4}


def round_stats(df: DataFrame) -> DataFrame:
    """Statistics as the queries report them: rounded effects, p-values as -log10."""
    out = {c: F.round(F.col(c), d) for c, d in STAT_DIGITS.items() if c in df.columns}
    out |= {c: F.when(F.col(c) > 0, F.round(-F.log10(F.col(c)), d) + 0.0) for c, d in LOG_STATS.items() if c in df.columns}
    return df.withColumns(out)


def sql_round_stats(cols: list[str]) -> str:
    def one(c: str) -> str:
        if c in LOG_STATS:
            return f"CASE WHEN {c} > 0 THEN round(-log10({c}), {LOG_STATS[c]}) + 0.0 END AS {c}"
        return f"round({c}, {STAT_DIGITS[c]}) AS {c}" if c in STAT_DIGITS else c
    return ", ".join(map(one, cols))


def sql_fisher_ctes(base: str) -> str:
    """CTEs ``fisher_p(a,b,c,d,pvalue)`` over the FULL support of every
    distinct table of ``base`` (brute force, with lgamma)."""
    return f"""
fisher_t AS (SELECT DISTINCT a, b, c, d FROM {base} WHERE least(a, b, c, d) >= 0 AND a + b + c + d > 0),
fisher_k AS (SELECT a, b, c, d, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS k FROM fisher_t),
fisher_terms AS (
  SELECT a, b, c, d,
         lgamma(a + 1) + lgamma(b + 1) + lgamma(c + 1) + lgamma(d + 1) AS dobs,
         lgamma(k + 1) + lgamma(a + b - k + 1) + lgamma(a + c - k + 1) + lgamma(d - a + k + 1) AS dk,
         lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1)
           - lgamma(a + b + c + d + 1) AS cst
  FROM fisher_k),
fisher_p AS (
  SELECT a, b, c, d, least(sum(CASE WHEN dk >= dobs - greatest(1e-7, 8 * pow(2, -53) * (a + b + c + d + 1) * ln(a + b + c + d + 1)) THEN exp(cst - dk) ELSE 0 END), 1.0) AS pvalue
  FROM fisher_terms GROUP BY a, b, c, d)"""


SQL_OR = """
  CASE WHEN a = 0 OR b = 0 OR c = 0 OR d = 0 THEN 0.5 ELSE 0.0 END AS sh"""


def sql_with_stats(base: str, cols: list[str]) -> str:
    """SELECT over ``base`` adding or_result, lower_ci, upper_ci, pvalue.
    Requires the fisher CTEs over the same base."""
    keep = ", ".join(f"x.{c}" for c in cols)
    return f"""
SELECT {keep}, fp.pvalue AS pvalue,
  CASE WHEN ok THEN ((a + sh) * (d + sh)) / ((b + sh) * (c + sh)) END AS or_result,
  CASE WHEN ok THEN exp(ln(((a + sh) * (d + sh)) / ((b + sh) * (c + sh)))
      - 1.959963984540054 * sqrt(1 / (a + sh) + 1 / (b + sh) + 1 / (c + sh) + 1 / (d + sh))) END AS lower_ci,
  CASE WHEN ok THEN exp(ln(((a + sh) * (d + sh)) / ((b + sh) * (c + sh)))
      + 1.959963984540054 * sqrt(1 / (a + sh) + 1 / (b + sh) + 1 / (c + sh) + 1 / (d + sh))) END AS upper_ci
FROM (SELECT *, {SQL_OR}, least(a, b, c, d) >= 0 AS ok FROM {base}) x
LEFT JOIN fisher_p fp USING (a, b, c, d)"""
