"""Document quality by rules, judged together for each host, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.operators.joins import HOT_SHARE
from tripweave.sources.shared import written

SPACE, WORD_START = "[\\x20\\x09-\\x0D]+", "[^\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
#: A host is rejected when the shrunk rate of one rule's failures is above this.
MOST_FAILURES = 0.5
#: Strength of a prior, in documents, at most: that of hosts whose rates differ no more than chance lets them.
MOST_STRENGTH = 1_000_000.0
#: Rules that a host's documents are counted by.
RULES = {
    "fail_base": "base_failed",
    "fail_symbols": "5 * n_symbols > word_chars",
    "fail_lines": "2 * n_dup_lines > n_lines",
}


def measures(docs: DataFrame, kept: Column, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(kept, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed) of whole texts.

    kept is a column of docs to take along, such as the id or a struct of them all. Everything is worked out within a row: repeated windows are found by sorting the
    hashes of a text's windows (64 bits) with their places, and only in texts that have
    any. Time grows with the length times its logarithm.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(kept.alias("kept"), F.col(host_col).alias("host"), text.alias("text"))
    rows = rows.withColumns({
        "words": F.array_remove(F.split("text", SPACE), ""),
        "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD_START)),
        "n_symbols": (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long"),
    }).drop("text")
    n = F.size("words")
    rows = rows.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "windows": F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")),
    }).drop("words", "lines")
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("placed", F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("windows")
    m = F.size("placed") - 1
    rows = rows.withColumn("same", F.zip_with(F.slice("placed", 1, m), F.slice("placed", 2, m), lambda a, b: a["h"] == b["h"]))
    before = lambda k: F.coalesce(F.get("same", k - 1), F.lit(False))
    after = lambda k: F.coalesce(F.get("same", k), F.lit(False))
    marked = F.transform("placed", lambda s, k: F.when(before(k) | after(k), s["i"]))
    rows = rows.withColumn("places", F.array_sort(F.filter(marked, lambda x: x.isNotNull()))).drop("placed", "same")
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("places")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def host_verdicts(rows: DataFrame) -> DataFrame:
    """(host, documents, host_rejected) from measured rows.

    The failures of each rule among a host's documents are shrunk to the rate of
    all documents by a beta prior fitted to the hosts (beta_prior): a host with few
    documents is judged by what hosts are like, one with many by its own.
    """
    hosts = rows.groupBy("host").agg(F.count("*").alias("documents"), *(F.count_if(F.expr(rule)).alias(name) for name, rule in RULES.items()))
    hosts = written(hosts, "hosts")
    n = F.col("documents")
    sums = [f for name in RULES for f in (F.sum(name), F.sum(F.col(name) * F.col(name) / n))]
    found = hosts.agg(F.count("*"), F.sum(n), F.sum(n.cast("double") * n), *sums).first()
    rejected = F.lit(False)
    for k, name in enumerate(RULES):
        alpha, beta = beta_prior(*found[:3], found[3 + 2 * k], found[4 + 2 * k])
        rejected = rejected | ((F.col(name) + alpha) / (F.col("documents") + (alpha + beta)) > MOST_FAILURES)
    return hosts.select("host", "documents", rejected.alias("host_rejected"))


def beta_prior(hosts: int, documents: int | None, squared: float | None, failures: int | None, ratios: float | None) -> tuple[float, float]:
    """Beta distribution of the hosts' failure rates, by moments of the beta-binomial that weigh a host by its documents.

    squared: sum of the squares of the hosts' documents; ratios: sum of failures squared over documents. The spread between hosts is what exceeds
    the spread within them (the binomial noise of finite hosts isn't taken for a difference); their intraclass correlation r
    gives the strength 1 / r - 1. Where no spread is left, or nothing tells spread from noise, the strength is MOST_STRENGTH.
    """
    if not documents:
        return 0.0, MOST_STRENGTH
    mean, strength = failures / documents, MOST_STRENGTH
    if hosts > 1 and documents > hosts:
        between = (ratios - failures * mean) / (hosts - 1)
        within = (failures - ratios) / (documents - hosts)
        usual = (documents - squared / documents) / (hosts - 1)
        extra, whole = between - within, between + (usual - 1) * within
        if extra > 0 and whole > 0:
            strength = min(whole / extra - 1, MOST_STRENGTH)
    return mean * strength, (1 - mean) * strength


def judged(docs: DataFrame, kept: Column, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The columns of measures() with host_rejected and passed: neither the document nor its host was rejected.

    The measured rows are written once. Rejected hosts with more than 1/HOT_SHARE of all documents are fewer than HOT_SHARE and broadcast; the
    others are joined by a plain join, in which no host has more than that share, if there are any.
    """
    rows = written(measures(docs, kept, text_col, host_col), "measures")
    verdicts = host_verdicts(rows)
    total = verdicts.agg(F.sum("documents")).first()[0] or 0
    bad = verdicts.filter("host_rejected").withColumn("hot", F.col("documents") * HOT_SHARE > F.lit(total))
    side = lambda test, mark: bad.filter(test).select(F.col("host").alias("bad_host"), F.lit(True).alias(mark))
    same = F.col("host").eqNullSafe(F.col("bad_host"))
    rows = rows.join(F.broadcast(side("hot", "bad")), same, "left").drop("bad_host")
    if bad.filter("not hot").isEmpty():
        rejected = F.col("bad").isNotNull()
    else:
        rows = rows.join(side("not hot", "worse"), same, "left").drop("bad_host")
        rejected = F.col("bad").isNotNull() | F.col("worse").isNotNull()
    rows = rows.withColumn("host_rejected", rejected).drop("bad", "worse")
    return rows.withColumn("passed", ~F.col("base_failed") & ~F.col("host_rejected"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Each row's measures and verdict: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, host_rejected.

    A null text counts as empty (no words: base_failed); rows without a host are
    one host; repeated rows are judged alike; an empty table gives no rows; other columns aren't read. kept is false if the
    document fails the base rules or its host is rejected.
    """
    rows = judged(docs, F.col(id_col), text_col, host_col)
    return rows.select(F.col("kept").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("passed").alias("kept"), "n_lines", "host_rejected")
