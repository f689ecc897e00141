"""Keys and reproducible draws."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripweave.sources.shared import written


def joined_key(*parts: Column | str, separator: str = "|") -> Column:
    """The parts as text with separators; null if any part is null."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    pieces = [columns[0].cast("string")]
    for c in columns[1:]:
        pieces += [F.lit(separator), c.cast("string")]
    return F.concat(*pieces)


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the parts alone: the first 32 bits of their MD5.

    The same rows draw the same numbers on any cluster and in any order.
    """
    return F.conv(F.substring(F.md5(joined_key(*parts)), 1, 8), 16, 10).cast("double") / float(1 << 32)


def below(limit: float, *parts: Column | str) -> Column:
    """Whether uniform() of the parts is below a limit, read from the digest's text, which spares making its number."""
    most = math.ceil(limit * 2**32)
    digest = F.md5(joined_key(*parts))
    return digest < F.lit(f"{most:08x}") if 0 <= most < 1 << 32 else digest.isNotNull() & F.lit(most > 0)


def dense_ids(df: DataFrame, bucket: Column, *order: str, name: str = "id") -> DataFrame:
    """Adds numbers 0, 1, ... in the order of columns that together are unique (nulls first).

    bucket must not fall along that order (the day of a timestamp, say). Rows are numbered within their
    bucket, and a bucket's numbers start after the rows of all before it, so no task orders all rows:
    only one row per bucket is ever brought together. What df takes is worked out once: the ranked rows are written.
    """
    by = [F.col(c).asc_nulls_first() for c in order]
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(*by))
    rows = written(df.withColumn("_bucket", bucket).withColumn("_rank", rank), "ranked")
    before = Window.orderBy(F.col("_bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_bucket").agg(F.count("*").alias("_n")).select(F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rows = rows.join(starts, F.col("_bucket").eqNullSafe(F.col("_b")))
    return rows.withColumn(name, F.col("_start") + F.col("_rank") - 1).drop("_bucket", "_b", "_start", "_rank")


def running(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """Adds, under each name, the sum of a column of whole numbers over the row and all before it in an order that leaves no ties.

    Rows are dealt over the tasks by ranges of the order and summed within a range; a range starts with the total of all before it. So
    no task orders all rows whatever their values are, and only one row per range is brought together. df should be a written table: dealing by ranges reads it twice.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    upto = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(F.col("_range").alias("_of")).agg(*(F.sum(c).alias(f"_before_{k}") for k, c in sums.items()))
    starts = totals.select("_of", *(F.coalesce(F.sum(f"_before_{k}").over(before), F.lit(0)).alias(f"_before_{k}") for k in sums))
    found = rows.withColumns({k: F.sum(c).over(upto) for k, c in sums.items()}).join(F.broadcast(starts), F.col("_range") == F.col("_of"))  # a row per task
    return found.withColumns({k: F.col(k) + F.col(f"_before_{k}") for k in sums}).drop("_range", "_of", *(f"_before_{k}" for k in sums))


def numbered(df: DataFrame, *order: Column | str, name: str = "id") -> DataFrame:
    """Adds numbers 0, 1, ... in an order that leaves no ties, by running(); df should be a written table."""
    found = running(df, [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in order], **{name: F.lit(1)})
    return found.withColumn(name, F.col(name) - 1)


def ranked_within(df: DataFrame, groups: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds the rank (1, 2, ...) within groups in an order that leaves no ties; no task orders a group. df should be a written table, groups few and not null."""
    rows = running(df, [*map(F.col, groups), *order], **{name: F.lit(1)})
    first = rows.groupBy(*groups).agg((F.min(name) - 1).alias("_before"))
    return rows.join(first, groups).withColumn(name, F.col(name) - F.col("_before")).drop("_before")
