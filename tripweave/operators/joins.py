"""Joins whose hot keys aren't gathered in one task, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of all rows is hot; there can be at most so many of them.
HOT_SHARE = 2_000


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], counted: str, outer: bool = False) -> DataFrame:
    """rows with the other columns of table, which has one row for each key and, in `counted`, how many of rows have that key.

    Keys with more than 1/HOT_SHARE of all counted rows are fewer than HOT_SHARE, whatever the data's size, so their rows of the
    table are broadcast; all others are joined by a plain join, in which no key has more than that share. Null
    keys are keys like any other. Rows without a match are left out, unless outer: then they stay, with nulls.
    `counted` is dropped; table should be a written one, as it is read several times.
    """
    total = table.agg(F.sum(counted)).first()[0] or 0
    is_hot = F.col(counted) * HOT_SHARE > F.lit(total)
    rest = [c for c in table.columns if c not in (*keys, counted)]
    side = lambda t: t.select(*(F.col(k).alias(f"_{k}") for k in keys), *rest)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    drop = [f"_{k}" for k in keys]
    few = side(table.filter(is_hot))
    hot = rows.join(F.broadcast(few), same)
    cold = rows.join(F.broadcast(few.select(*drop)), same, "left_anti").join(side(table.filter(~is_hot)), same, "left" if outer else "inner")
    return hot.unionByName(cold).drop(*drop)
