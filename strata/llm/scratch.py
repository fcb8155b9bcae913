"""What the operators share: tables in the shared folder, and column names that clash with none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path, written

__all__ = ["documents", "fresh", "joined", "new_path", "written"]

#: Keys of more than one row in so many are fewer than this: so many may be broadcast.
COMMON = 1000


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that clash with none of ``df``, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def joined(rows: DataFrame, keyed: DataFrame, on: str, total: int) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row for each key and in ``many`` the number of its rows
    (not kept).  ``total`` is the number of rows, or more.  Common keys are broadcast, so that the rows of a
    hot key stay where they are; the others are shuffled."""
    common = F.broadcast(keyed.filter(F.col("many") * COMMON > total).drop("many"))
    rare = rows.join(common.select(on), on, "left_anti").join(keyed.drop("many"), on)
    return rows.join(common, on).unionByName(rare)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
