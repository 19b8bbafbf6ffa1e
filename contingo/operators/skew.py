"""Joins whose left side has a few very frequent keys.

A sketch of frequent items over the key column names the heavy keys. On the
left their rows are spread over ``ways`` salts, on the right their few rows
are repeated once a salt; all other keys have the one salt 0. The join on
(key, salt) gives the rows of the plain join, and a key that holds a third of
the rows is worked on by ``ways`` tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class HotKeys:
    """Heavy values of the first of ``keys``: those with at least ``share`` of the rows of ``frame`` (the sketch
    misses none of them and is bounded by 1 / share entries). It is a scalar of the plan: nothing is collected."""

    frame: DataFrame
    keys: list[str]
    share: float = 0.01
    ways: int = 32
    salt_by: Sequence[str] = field(default_factory=list)

    def heavy(self) -> Column:
        """Array of heavy keys."""
        key = self.keys[0]
        kept = max(1, int(1 / self.share))
        sketch = self.frame.where(F.col(key).isNotNull()).agg(
            F.expr(f"approx_top_k(`{key}`, {kept}, {min(1_000_000, max(64, 16 * kept))})").alias("top"),
            F.count(F.lit(1)).alias("n"))
        often = F.filter("top", lambda e: e["count"] >= F.col("n") * self.share)
        return sketch.select(F.transform(often, lambda e: e["item"]).alias("heavy")).scalar()

    def join(self, left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
        """left.join(right, keys, how) for how inner or left."""
        if how not in ("inner", "left"):
            raise ValueError("only the left side is split: inner or left")
        heavy, key = self.heavy(), F.col(self.keys[0])
        hot = F.coalesce(F.array_contains(heavy, key), F.lit(False))
        by = [F.col(c) for c in self.salt_by or [c for c in left.columns if c not in keys]]
        spread = F.pmod(F.xxhash64(*by), F.lit(self.ways)).cast("int") if by else F.lit(0)
        rows = left.withColumn("_salt", F.when(hot, spread).otherwise(F.lit(0)))
        copies = F.when(hot, F.sequence(F.lit(0), F.lit(self.ways - 1))).otherwise(F.array(F.lit(0)))
        table = right.withColumn("_salt", F.explode(copies))
        return rows.join(table, [*keys, "_salt"], how).drop("_salt")
