"""How tiles are dealt to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.group import GroupedData


def deal(df: DataFrame, a_task: int = 4) -> DataFrame:
    """``df`` dealt by ``sb`` to ``a_task`` times as many tasks as shuffles have. Work on a tile is long beside its bytes, so tasks
    must not be merged by their bytes; the number given here keeps them apart."""
    return df.repartition(a_task * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sb")


def by_tile(df: DataFrame, a_task: int = 4) -> GroupedData:
    """``df`` grouped by ``sb`` as dealt; the grouping needs no further shuffle."""
    return deal(df, a_task).groupBy("sb")
