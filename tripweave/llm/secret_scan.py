"""Secrets in documents: candidate strings judged by a random forest, in DataFrame operations only."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.llm import secret_findings
from tripweave.sources.shared import written

# Words that name a secret, marks of examples, what digests and numbers are called, and path parts of tests.
SECRET_WORDS = r"(?i:token|secret|passw(?:or)?d|passwd|passphrase|api[_-]?key|access[_-]?key|auth|bearer|credential|private)"
EXAMPLE_WORDS = r"(?i)(example|sample|dummy|placeholder|changeme|replace|xxxx|0000000|1234567|abcdef0|your[_-])"
PLAIN_WORDS = r"(?i)(commit|\bsha-?\d*\b|md5|checksum|digest|hash|etag|revision|uuid|guid|\bid\b|isbn|order|invoice|number|phone|card|version|serial|request|base64)"
TEST_PATHS = r"(?i)(test|example|docs|fixture|mock|sample)"
#: A value that is assigned under a secret's name: the name, what assigns, and a quote that may follow.
_ASSIGN = rf"{SECRET_WORDS}[A-Za-z0-9_.-]*+[\"']?[ \t]*+(?:=>|[:=]{{1,2}})[ \t]*+(?:(?i:bearer|basic)[ \t]++)?"
_PREFIX = rf"(?s)^(?:{_ASSIGN}[\"']?(?=.{{4,}})|(?i:bearer)[ \t]++)"
#: What is judged: blocks of private keys; quoted and bare values of 4 characters or more that are assigned under a secret's name; what follows
#: `Bearer`; and runs of 12 or more characters of the usual encodings with a digit, dotted or not, that aren't a name before `=`.
CANDIDATE = "|".join([
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----",
    rf"{_ASSIGN}(?:\"[^\"\r\n]{{4,}}+\"|'[^'\r\n]{{4,}}+'|[^\s\"'&;,]{{4,}}+)",
    r"(?i:\bbearer)[ \t]++[A-Za-z0-9._~+/-]{16,}+={0,2}+",
    r"(?<![A-Za-z0-9_+/.-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{12,}+(?:\.[A-Za-z0-9_-]{4,}+)*+(?!=+[\"'A-Za-z0-9_+/-])={0,2}+",
])
#: So many whole words before and after a candidate are its neighbours.
NEIGHBOURS = 5
#: A word of the dictionary is at least one in so many of all words, so there are at most so many of them.
ONE_IN = 1_000_000
#: So many of the most frequent words make up the texts of the labelled findings.
COMMON_WORDS = 400
#: Bound: labelled findings that are learned from.
MOST_FINDINGS = 20_000
TREES, DEPTH, SEED = 40, 10, 5
FEATURES = (
    "length", "digits", "uppers", "symbols", "spaces", "hex_only", "digits_only", "turns", "syllables", "repeats", "distinct", "dictionary",
    "assigned", "quoted", "secret_word", "example_word", "plain_word", "words_around", "path_test", "path_depth",
)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(id, path, start, value, prefix, before, after) of each candidate in whole texts; start counts characters from 0.

    A text is split at its candidates, so that the parts between them are the neighbouring text; before and after hold the NEIGHBOURS
    nearest whole words of it, prefix what assigns the value (part of before).
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), text.alias("text")).filter(F.col("text").rlike(CANDIDATE))
    rows = rows.select("id", "path", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split("text", CANDIDATE, -1).alias("between"))
    # Where each match starts: the lengths of all parts before it, as running sums.
    sizes = F.zip_with("found", F.slice("between", 1, F.size("found")), lambda v, b: F.struct(F.length(v).alias("v"), F.length(b).alias("b")))
    starts = F.aggregate(
        sizes,
        F.struct(F.array().cast("array<bigint>").alias("at"), F.lit(0).cast("bigint").alias("end")),
        lambda acc, s: F.struct(F.concat(acc["at"], F.array(acc["end"] + s["b"])).alias("at"), (acc["end"] + s["b"] + s["v"]).alias("end")),
        lambda acc: acc["at"],
    )
    rows = rows.withColumn("starts", starts)
    rows = rows.select("id", "path", F.explode(F.arrays_zip("found", "starts", F.slice("between", 1, F.size("found")).alias("before"), F.slice("between", 2, F.size("found")).alias("after"))).alias("x"))
    rows = rows.select("id", "path", "x.*", F.regexp_extract("x.found", _PREFIX, 0).alias("prefix"))
    closing = F.when(F.col("prefix").rlike("[\"']$"), F.expr("right(found, 1)")).otherwise("")
    rows = rows.withColumn("closing", closing)
    value = F.substr("found", F.length("prefix") + 1, F.length("found") - F.length("prefix") - F.length("closing"))
    before = F.split(F.regexp_replace(F.concat("before", "prefix"), r"^\s+", ""), r"\s+")
    after = F.split(F.regexp_replace(F.concat("closing", "after"), r"\s+$", ""), r"\s+")
    return rows.select(
        "id", "path", (F.col("starts") + F.length("prefix")).alias("start"), value.alias("value"), "prefix",
        F.array_join(F.slice(before, F.greatest(F.lit(1), F.size(before) - (NEIGHBOURS - 1)), NEIGHBOURS), " ").alias("before"), F.array_join(F.slice(after, 1, NEIGHBOURS), " ").alias("after"),
    )


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) of all words in all texts: three letters or more between white space (and a mark after them), in lower case.

    Strings with digits or signs in them aren't words, so that pieces of secrets don't enter.
    """
    found = F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit(r"(?<!\S)(\p{L}{3,}+)[.,;:!?]?(?!\S)"), F.lit(1))
    words = docs.select(F.explode(found).alias("word"))
    return written(words.groupBy("word").agg(F.count("*").alias("n")), "words")


def dictionary(counts: DataFrame) -> DataFrame:
    """(word) of those that are one in ONE_IN of all words or more: ONE_IN rows at most, whatever the texts' size."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return written(counts.filter(F.col("n") * ONE_IN >= F.lit(total)).select("word"), "dictionary")


def common_words(counts: DataFrame, most: int = COMMON_WORDS) -> list[str]:
    """The most frequent words, of equal ones the first: what the labelled findings' texts are made of (at most COMMON_WORDS)."""
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()]


def featured(found: DataFrame, words: DataFrame) -> DataFrame:
    """The candidates with the numbers in FEATURES; `words` is the dictionary, a table of ONE_IN rows at most."""
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "found")  # the number is fixed from here on
    parts = found.select("row", F.explode(F.split(F.lower("value"), r"[^\p{L}]+")).alias("word")).filter(F.length("word") >= 3)
    covered = parts.join(F.broadcast(words), "word").groupBy("row").agg(F.sum(F.length("word")).alias("covered"))
    found = found.join(covered, "row", "left")
    n = F.length("value")
    share = lambda pattern: F.regexp_count("value", F.lit(pattern)) / n
    around = F.concat_ws(" ", "before", "after")
    values = {
        "length": F.log1p(n),
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "symbols": share(r"[^\p{L}0-9\s]"),
        "spaces": share(r"\s"),
        "hex_only": F.col("value").rlike("^[0-9a-fA-F]+$"),
        "digits_only": F.col("value").rlike("^[0-9]+$"),
        # Changes from one class of characters to another, and from consonants to vowels.
        "turns": share("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"),
        "syllables": share("(?i)(?<=[b-df-hj-np-tv-z])[aeiou]"),
        "repeats": share(r"(.)(?=\1)"),
        "distinct": F.size(F.array_distinct(F.split("value", ""))) / n,
        "dictionary": F.coalesce("covered", F.lit(0)) / n,
        "assigned": F.col("prefix") != "",
        "quoted": F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']"),
        "secret_word": F.col("before").rlike(SECRET_WORDS),
        "example_word": F.concat_ws(" ", "value", "before", "after").rlike(EXAMPLE_WORDS),
        "plain_word": F.col("before").rlike(PLAIN_WORDS),
        "words_around": F.regexp_count(around, F.lit(r"(?<!\S)\p{L}{2,}[.,;:!?]?(?!\S)")) / (2 * NEIGHBOURS),
        "path_test": F.coalesce(F.col("path").rlike(TEST_PATHS), F.lit(False)),
        "path_depth": F.coalesce(F.regexp_count("path", F.lit("/")), F.lit(0)) / 10,
    }
    return found.select("id", "path", "start", "value", "before", "after", *(v.cast("double").alias(k) for k, v in values.items()))


def made_findings(spark: SparkSession, counts: DataFrame, words: DataFrame) -> DataFrame:
    """The labelled findings of secret_findings with the features of the candidate that lies at each one's place (nulls without one)."""
    made = written(secret_findings.findings(spark, common_words(counts)), "made")
    found = featured(candidates(made, "id", "text", "path"), words).withColumnRenamed("start", "at").drop("path")
    spans = made.select(F.col("id").alias("made_id"), "start", F.col("length").alias("span"), "label", "kind", "held_out")
    near = (F.col("at") < F.col("start") + F.col("span")) & (F.col("at") + F.length("value") > F.col("start"))
    return spans.join(found, (F.col("id") == F.col("made_id")) & near, "left").drop("id").withColumnRenamed("made_id", "id")


def train(labelled: DataFrame, most_findings: int = MOST_FINDINGS) -> PipelineModel | None:
    """A forest learned from featured findings with a `label`; about most_findings of them, by a hash of their value and place.

    None if there is no finding or all have one label.
    """
    rows = labelled.filter(F.col("label").isNotNull() & F.col("value").isNotNull()).select("id", "start", "value", "label", *FEATURES)
    there, least, most = rows.agg(F.count("*"), F.min("label"), F.max("label")).first()
    if not there or least == most:
        return None
    if there > most_findings:
        rows = rows.filter(F.pmod(F.xxhash64("id", "start", "value"), F.lit(1 << 40)) < int((1 << 40) * (most_findings / there)))
    rows = written(rows.repartition(4, "id", "start").sortWithinPartitions("id", "start", "value"), "findings")
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return PipelineModel([assemble, forest.fit(assemble.transform(rows))])


def scored(found: DataFrame, model: PipelineModel | None) -> DataFrame:
    """Featured candidates with `score`; all 1 without a model."""
    if model is None:
        return found.withColumn("score", F.lit(1.0))
    return model.transform(found).withColumn("score", F.element_at(vector_to_array("probability"), 2))


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """One row per candidate: id_col, path, start, length, value, score (0 to 1), is_secret.

    labelled: findings (id, start, label) of these documents that people judged; without it, the findings that secret_findings makes are
    learned from, but for those held out. Null and empty texts have no candidates, and in a text of any length all are found; a null path has no
    path features; repeated rows give repeated findings, an empty table none. With nothing to learn from, all candidates score 1: none is
    dropped unseen. The texts are read twice (words, candidates); of these only
    words with their counts, and the few candidates, move.
    """
    counts = word_counts(docs, text_col)
    words = dictionary(counts)
    found = written(featured(candidates(docs, id_col, text_col, path_col), words), "candidates")
    if labelled is None:
        seen = made_findings(docs.sparkSession, counts, words).filter("not held_out")
    else:
        seen = found.join(labelled.select("id", "start", F.col("label").cast("double").alias("label")), ["id", "start"])
    rows = scored(found, train(seen))
    return rows.select(F.col("id").alias(id_col), "path", "start", F.length("value").cast("long").alias("length"), "value", "score", (F.col("score") >= threshold).alias("is_secret"))
