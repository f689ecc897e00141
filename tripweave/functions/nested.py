"""Nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten(df: DataFrame, separator: str = "__") -> DataFrame:
    """Structs, at any depth, as columns whose names join the names on the way."""

    def leaves(fields: list[T.StructField], path: tuple[str, ...]) -> list[Column]:
        out = []
        for f in fields:
            way = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                out += leaves(f.dataType.fields, way)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in way)).alias(separator.join(way)))
        return out

    return df.select(*leaves(df.schema.fields, ()))
