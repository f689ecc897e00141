"""Mixing sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripweave.operators.joins import join_counted
from tripweave.sources.shared import written

WEIGHTS, SHARE, MOST_EPOCHS, SEED = (3, 1, 2), 1.5, 2, 7
WORD = "[^\\x20\\x09-\\x0D]+"
#: Documents of a source are drawn by 32 hash bits; sums are taken by so many of the first bits, and those by the first half of these.
BUCKET_BITS = 16


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_epochs: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, documents, target) by capped water-filling, from rows of (source, size).

    Sources in code point order (null last) take the weights in turn. The budget
    is `share` of all sizes; a source's target stops at most_epochs times its size and the rest is
    dealt again by weight until none is above. The sources are ordered by cap per weight, so those
    that stop come first and the level that the others share follows
    from running sums: this is where dealing again comes to rest. The windows are over one row per source.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    sources = sources.withColumn("cap", F.col("source_size") * F.lit(most_epochs))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    sources = sources.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(share)).alias("budget"),
        F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("stopped"),
        F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)).alias("open_weight"),
        F.row_number().over(by_cap).alias("turn"),
    )
    sources = sources.withColumn("level", (F.col("budget") - F.col("stopped")) / F.col("open_weight"))
    sources = sources.withColumn("at_cap", F.col("cap") <= F.col("level") * F.col("weight"))
    level = F.min(F.when(~F.col("at_cap"), F.struct("turn", "level"))).over(everything)["level"]
    target = F.when(F.col("at_cap"), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return sources.select("source", "source_size", "documents", target.cast("double").alias("target"))


def mix(docs: DataFrame, id_col: str | Column = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_epochs: float = MOST_EPOCHS, seed: int = SEED) -> DataFrame:
    """Each row's share in the mix: id_col, source, size, source_size, target, copies, taken.

    size counts words (a null text has none). A source with a target of r times its
    size takes floor(r) copies of each of its documents, and one more of those that come
    first in a seeded order, as long as the words still fit; then the one document
    left whose size is nearest to what is still missing, if that brings it nearer.
    Rows that repeat a document count as documents of their own. A null source is a source. id_col
    may be a column of its own, such as a struct (then named id).

    The texts are read once. The order follows a hash of the id and the text, so rows that share an id (or have none) are spread
    too. It is never sorted as a whole: sizes are summed by source and hash bucket, the 2^8 coarse buckets and then the 2^8 fine ones
    of the coarse one in which the target is met are run through, and only that fine one's rows are ordered: a hot source costs no
    task more than a few hundred sums and a 2^16th of its rows. Sources of many rows are joined by join_counted(). An empty table
    gives no rows.
    """
    words = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.col(id_col) if isinstance(id_col, str) else id_col
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))), 1, 8), 16, 10).cast("long")
    rows = docs.select(key.alias("id"), F.col(source_col).alias("source"), words.alias("size"), drawn.alias("draw"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")  # the number is fixed from here on
    rows = rows.withColumn("bucket", F.shiftright("draw", 32 - BUCKET_BITS))

    plan = targets(rows, weights, share, most_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = written(plan.withColumnRenamed("source", "s"), "targets")
    same = F.col("source").eqNullSafe(F.col("s"))

    # The bucket of each source in which the running sum passes its part.
    sums = written(rows.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "sums").withColumn("coarse", F.shiftright("bucket", BUCKET_BITS // 2))
    coarse = sums.groupBy("source", "coarse").agg(F.sum("size").alias("size"))
    first = _passing(coarse, plan.select("s", "part", F.lit(0).cast("long").alias("before")), "coarse", same)
    fine = sums.join(first.withColumnRenamed("s", "f"), F.col("source").eqNullSafe(F.col("f")) & (F.col("coarse") == F.col("cut"))).select("source", "bucket", "size")
    cuts = _passing(fine, first.drop("cut"), "bucket", same)
    cuts = written(plan.join(cuts.drop("part").withColumnRenamed("s", "c"), F.col("s").eqNullSafe(F.col("c")), "left").drop("c").withColumnRenamed("s", "source"), "cuts")

    rows = join_counted(rows, cuts, ["source"], "documents")
    inside = rows.filter("bucket = cut").withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("draw", "id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)))
    more = F.when(F.col("part") > 0, F.col("cut").isNull() | (F.col("bucket") < F.col("cut"))).otherwise(False)
    rows = rows.filter("cut is null or bucket <> cut").withColumn("more", more).unionByName(inside.withColumn("more", (F.col("upto") <= F.col("part")) & (F.col("part") > 0)).drop("upto"))
    rows = written(rows.drop("cut", "before", "bucket"), "drawn")

    # One last document closes the gap.
    gaps = rows.groupBy("source").agg((F.max("part") - F.sum(F.when(F.col("more"), F.col("size")).otherwise(0))).alias("gap"), F.count_if(~F.col("more") & (F.col("part") > 0)).alias("left"))
    left = join_counted(rows.filter("not more and part > 0"), written(gaps, "gaps"), ["source"], "left").withColumn("off", F.abs(F.col("size") - F.col("gap"))).filter("off < gap")
    last = left.groupBy("source").agg(F.min(F.struct("off", "draw", "id", "size", "row"))["row"].alias("last_row")).select("last_row")
    rows = rows.join(last, F.col("row") == F.col("last_row"), "left")  # a row per source
    copies = F.col("whole") + (F.col("more") | F.col("last_row").isNotNull()).cast("long")
    return rows.select(F.col("id").alias(id_col if isinstance(id_col, str) else "id"), "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def _passing(sums: DataFrame, parts: DataFrame, bucket: str, same: Column) -> DataFrame:
    """(s, part, cut, before): the first bucket at which a source's running sum, from `before` on, passes its part, and the sum before it."""
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy(bucket))
    rows = sums.join(parts, same).withColumn("upto", upto).filter("upto > part")
    return rows.groupBy("s").agg(F.max("part").alias("part"), F.min(bucket).alias("cut"), F.min(F.col("upto") - F.col("size")).alias("before"))
