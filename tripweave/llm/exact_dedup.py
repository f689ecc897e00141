"""Exact duplicates by deterministic block naming, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripweave.operators import joins
from tripweave.sources.shared import written

BLOCK_BYTES = 8192


def named(rows: DataFrame, values: list[str], spread: list[str], total: int, name: str) -> DataFrame:
    """The rows with `name` (long) for their tuple of values: equal names if and only if equal values.

    Values are dealt over 2^31 buckets and sorted within; a name is the bucket and
    the value's rank among the bucket's different ones, so two values that fall in
    one bucket still differ in rank. Only values are compared, no hash is trusted.

    A bucket that holds more than 1/HOT_SHARE of the rows (there are fewer than HOT_SHARE of them) is sorted in as many parts as it has
    such shares (by a hash of the columns in `spread`), and then one row for each different value
    of each part is ranked; so no task sorts much more than that share, whatever a bucket holds. The values themselves
    aren't kept in the result, which is written to the shared folder.
    """
    rows = rows.withColumn("_bucket", F.xxhash64(*values).bitwiseAND(F.lit(0x7FFFFFFF)))
    parts = F.ceil(F.col("count") * joins.HOT_SHARE / F.lit(max(total, 1))).cast("int")
    salts = written(rows.groupBy("_bucket").count().withColumn("_parts", parts).filter("_parts > 1").select("_bucket", "_parts"), "salts")
    rows = rows.join(F.broadcast(salts), "_bucket", "left")  # fewer than HOT_SHARE rows
    is_hot = F.col("_parts").isNotNull()
    rows = rows.withColumn("_salt", F.coalesce(F.pmod(F.hash(*spread), F.col("_parts")), F.lit(0)))
    by = Window.partitionBy("_bucket", "_salt").orderBy(*values)
    rows = rows.select("*", F.dense_rank().over(by).alias("_rank"), F.rank().over(by).alias("_first"), F.row_number().over(by).alias("_row"))
    keep = [c for c in rows.columns if c not in (*values, "_first", "_row")]
    # One row of each different value of a hot bucket's part takes the values along.
    taken = [F.when(is_hot & (F.col("_first") == F.col("_row")), F.col(v)).alias(f"_v{k}") for k, v in enumerate(values)]
    rows = written(rows.select(*keep, *taken), "named")
    label = lambda rank: F.shiftleft(F.col("_bucket"), 32).bitwiseOR(rank.cast("long")).alias(name)
    outer = [c for c in keep if c not in ("_bucket", "_parts", "_salt", "_rank")]
    cold = rows.filter(~is_hot).select(*outer, label(F.col("_rank")))
    if salts.isEmpty():
        return cold
    firsts = rows.filter(is_hot & F.col("_v0").isNotNull())
    ranks = firsts.select("_bucket", "_salt", "_rank", F.dense_rank().over(Window.partitionBy("_bucket").orderBy(*(f"_v{k}" for k in range(len(values))))).alias("_whole"))
    return cold.union(rows.filter(is_hot).join(ranks, ["_bucket", "_salt", "_rank"]).select(*outer, label(F.col("_whole"))))


def text_identities(docs: DataFrame, id_col: str | Column = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, sha, rows, level, name): (level, name) is equal exactly for equal texts.

    Texts are cut into blocks of block_bytes (the last may be shorter), the sorted blocks
    are named, and then adjacent names are paired and named again until one is left. Rows that
    agree in id and text come together in one row that counts them.
    """
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    texts = docs.select((F.col(id_col) if isinstance(id_col, str) else id_col).alias("id"), body.alias("body"))
    total, longest = texts.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.octet_length("body") / block_bytes))), F.max(F.octet_length("body"))).first()
    blocks = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / block_bytes).cast("int"))
    rows = texts.select("id", F.unhex(F.sha2("body", 256)).alias("sha"), "body", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("pos"), blocks.alias("blocks"))
    rows = rows.select("id", "sha", "blocks", "pos", F.expr(f"substring(body, pos * {block_bytes} + 1, {block_bytes})").alias("block"))
    rows = named(rows, ["block"], ["id", "pos"], total or 0, "name").groupBy("id", "sha", "blocks", "pos").agg(F.max("name").alias("name"), F.count("*").alias("rows"))
    left, level, out = max(1, -(-(longest or 0) // block_bytes)), 0, None
    while True:
        done = rows.filter("blocks = 1").select("id", "sha", "rows", F.lit(level).alias("level"), "name")
        out = out.union(done) if out else done
        if left == 1:
            return out
        at = lambda side: F.max(F.when(F.col("pos") % 2 == side, F.col("name")))
        pairs = rows.filter("blocks > 1").groupBy("id", "sha", "blocks", F.expr("pos div 2").cast("int").alias("pos")).agg(at(0).alias("one"), F.coalesce(at(1), F.lit(-1)).alias("two"), F.max("rows").alias("rows"))
        pairs = written(pairs.withColumn("blocks", F.expr("(blocks + 1) div 2").cast("int")), "pairs")
        left, level = (left + 1) // 2, level + 1
        rows = named(pairs, ["one", "two"], ["id", "pos"], pairs.count(), "name")


def exact_groups(docs: DataFrame, id_col: str | Column = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, sha, rows, keep_id, group_size): one row for each different pair of id and text, `rows` of which docs has.

    id_col may also be a column of its own, such as a struct. Classes of many rows are joined by join_counted(), so no task gathers them.
    """
    found = written(text_identities(docs, id_col, text_col, block_bytes), "identities")
    groups = written(found.groupBy("level", "name").agg(F.max("id").alias("keep_id"), F.sum("rows").alias("group_size"), F.count("*").alias("members")), "classes")
    return joins.join_counted(found, groups, ["level", "name"], "members").select("id", "sha", "rows", "keep_id", "group_size")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size (long), kept, text_sha256.

    Texts are equal when their UTF-8 bytes are; a null text counts as empty. Of
    each group of equal texts, the row with the largest id is kept (a null id only if there is no other). Rows that
    repeat both id and text each count and are each returned, and one of them can be kept. Other columns aren't read.

    The texts move once, as blocks; all later steps move a few numbers and a
    digest per document. Groups are counted with partial aggregates; neither naming nor the join back
    gathers a group of many rows in one task. An empty table gives no rows.
    """
    rows = exact_groups(docs, id_col, text_col, block_bytes).select("*", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("copy"))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return rows.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
