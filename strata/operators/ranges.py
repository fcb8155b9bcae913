"""Closed key ranges of tables: overlap, hull, chains and splits.

Ranges are joined by parts of the key space: each range goes to the parts that it meets, of which
there are as many as shuffle partitions, and ranges of one part are compared.  So no side is
broadcast whole, and no join compares all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut_points(keys: DataFrame) -> list[str]:
    """Keys (of column key) that cut them into about equal parts, fewer than shuffle partitions."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = keys.filter(F.col("key").isNotNull()).repartitionByRange(n, "key").select("key", F.spark_partition_id().alias("part"))
    return sorted({r.key for r in laid.groupBy("part").agg(F.min("key").alias("key")).collect()})[1:]  # a row a partition


def _part(cuts: list[str], key: Column) -> Column:
    """How many cuts are not above a key."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= key))


def meeting(a: DataFrame, b: DataFrame, left_a: str, right_a: str, left_b: str, right_b: str, how: str = "inner", on: list[str] | None = None) -> DataFrame:
    """``a`` joined with the rows of ``b`` whose range shares a key with its own (and whose ``on`` are equal).
    A pair is compared in the first part that both ranges are in; ``how`` is inner or left_semi."""
    cuts = cut_points(b.select(F.col(left_b).alias("key")))
    if how == "left_semi":
        a = a.withColumn("_row", F.struct(*a.columns))
    side = []
    for df, left, right, name in ((a, left_a, right_a, "_a"), (b, left_b, right_b, "_b")):
        first = _part(cuts, F.col(left))
        fit = df.filter(F.col(left) <= F.col(right)).withColumn(name, first)
        side.append(fit.withColumn("_part", F.explode(F.sequence(F.col(name), _part(cuts, F.col(right))))))
    x, y = side[0].alias("x"), side[1].alias("y")
    test = (F.col("x._part") == F.col("y._part")) & (F.col("x._part") == F.greatest("x._a", "y._b"))
    test &= (F.col(f"x.{left_a}") <= F.col(f"y.{right_b}")) & (F.col(f"x.{right_a}") >= F.col(f"y.{left_b}"))
    for c in on or []:
        test &= F.col(f"x.{c}") == F.col(f"y.{c}")
    if how == "left_semi":
        found = x.join(y, test, "left_semi")
        return found.select("x._row").distinct().select("_row.*")
    theirs = [c for c in b.columns if c not in a.columns]
    return x.join(y, test).select(*[f"x.{c}" for c in a.columns], *[f"y.{c}" for c in theirs])


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of ranges (left_a, right_a), (left_b, right_b) that share a key."""
    return meeting(a, b, "left_a", "right_a", "left_b", "right_b")


def hull(ranges: DataFrame, *by: str) -> DataFrame:
    return ranges.groupBy(*by).agg(F.min("min_key").alias("left"), F.max("max_key").alias("right"))


def chain(tables: DataFrame) -> DataFrame:
    """Which tables, from the oldest (smallest fid) on, join the range grown so far without a gap."""
    before = Window.orderBy("fid").rowsBetween(Window.unboundedPreceding, -1)
    rows = tables.withColumn("low", F.min("min_key").over(before)).withColumn("high", F.max("max_key").over(before))
    gap = (F.col("min_key") > F.col("high")) | (F.col("max_key") < F.col("low"))
    gaps = F.sum(F.when(gap, 1).otherwise(0)).over(Window.orderBy("fid"))
    return rows.select("fid", "min_key", "max_key", (gaps == 0).alias("in_chain"))


def split_points(bottom: DataFrame, n: int) -> DataFrame:
    """Upper bounds at every ``width``-th table's largest key, and after the last."""
    width = max(3, -(-n // 5))
    order = F.row_number().over(Window.orderBy("max_key", "fid"))
    rows = bottom.withColumn("n", order)
    return rows.filter((F.col("n") % width == 0) | (F.col("n") == n)).select(F.row_number().over(Window.orderBy("max_key")).cast("bigint").alias("split"), F.col("max_key").alias("right"))


def conflicts(plans: DataFrame, in_flight: DataFrame) -> DataFrame:
    """Plans whose range at a level overlaps none in flight there.  ``fid`` tells plans apart."""
    busy = in_flight.select("level", F.col("left").alias("busy_left"), F.col("right").alias("busy_right"))
    met = meeting(plans.select("fid", "level", "left", "right"), busy, "left", "right", "busy_left", "busy_right", on=["level"])
    return plans.join(met.select("fid").distinct(), "fid", "left_anti")
