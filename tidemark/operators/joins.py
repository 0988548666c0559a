"""As-of joins, upserts, priority merges, snapshot differences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], on: str, take: list[str], tie: str, within_days: int | None = None, span: Callable[[Column], Column] | None = None) -> DataFrame:
    """left with `take` of the last row of right at or before it (none older than within_days).

    The rows of both sides are put in one order and the last right row is carried on: one shuffle by
    the keys, linear in the rows, where a join with a range would pair all rows of a key.

    span: a function of `on` that never falls as `on` rises, such as its month. The rows of a key are then split by it, so a
    frequent key is many tasks: the last right row of each span (an aggregate) is carried to the key's later spans, of which
    one window keeps a row each, and opens them as a row of its own.

    Right rows without `on` match nothing; left rows without it stay, unmatched.
    """
    cols = [c for c in left.columns if c not in by]
    right = right.where(F.col(on).isNotNull())
    kept = F.struct(F.col(on).alias("_on"), *(F.col(c).alias(c) for c in take))
    marks = right.select(*by, F.col(on).alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), kept.alias("_right"), F.lit(None).cast(left.select(F.struct(*cols)).schema[0].dataType).alias("_left"))
    rows = left.select(*by, F.col(on).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.lit(None).cast(marks.schema["_right"].dataType).alias("_right"), F.struct(*cols).alias("_left"))
    both, parts = marks.unionByName(rows), list(by)
    if span is not None:
        parts.append("_span")
        both = both.withColumn("_span", span(F.col("_at")))
        newest = F.max_by("_right", F.when(F.col("_side") == 0, F.struct("_at", "_tie")))
        before = F.last("_before", True).over(Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
        opening = both.groupBy(*parts).agg(newest.alias("_before")).select(*parts, before.alias("_right")).where("_right is not null and _span is not null")
        both = both.unionByName(opening.select(*parts, F.col("_right._on").alias("_at"), F.lit(0).alias("_side"), "_right"), allowMissingColumns=True)
    w = Window.partitionBy(*parts).orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    joined = both.withColumn("_last", F.last("_right", True).over(w)).where("_side = 1")
    ok = F.lit(True) if within_days is None else F.datediff("_at", "_last._on") <= within_days
    return joined.select(*by, "_left.*", *(F.when(ok, F.col(f"_last.{c}")).alias(f"right_{c}") for c in take))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key: the first in the order.

    Rank limits are pushed below the shuffle (each task sends on one row a key at most), so a frequent key stays cheap.
    """
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """stored with the rows of fresh in place of those with equal keys."""
    return stored.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def changes(before: DataFrame, after: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """added, dropped and changed rows of two snapshots."""
    b, a = before.select(*keys, F.col(value).alias("before")), after.select(*keys, F.col(value).alias("after"))
    both = b.withColumn("_b", F.lit(1)).join(a.withColumn("_a", F.lit(1)), keys, "full")
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "dropped").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return both.withColumn("change", kind).where("change is not null").drop("_a", "_b")
