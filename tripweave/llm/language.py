"""Language identification by known words, backing off to character n-grams."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm.chunks import Chunks, slices
from tripweave.sources.shared import written

#: Bound of the model: labelled rows that are read. All their words and n-grams up to that length are learned.
MOST_ROWS, LONGEST_GRAM = 20_000, 5
SMOOTH = 0.5
UNKNOWN = "und"
_WORD = regex.compile(r"\p{L}+")
#: Seed of Spark's xxhash64, by which words and n-grams are named.
_SEED = 42
#: Chunks whose scores a worker keeps.
MOST_CHUNKS = 200_000


class Model:
    """Log frequencies by language of words (level 0) and of the character n-grams of words (level n, with a space at either end).

    A level is a sorted array of names' 64-bit hashes and a table with a row for each; the model has neither strings nor dictionaries,
    so that it stays small when it is sent to the workers.
    """

    def __init__(self, languages: list[str], levels: list[tuple[np.ndarray, np.ndarray]]):
        """levels: (hashes, counts by language) for words and for each length of n-grams."""
        self.languages, self.levels = languages, []
        for keys, counts in levels:
            order = np.argsort(keys)
            table = counts[order] + SMOOTH
            self.levels.append((keys[order], np.log(table / table.sum(axis=0)).astype(np.float32)))

    def _known(self, level: int, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which of the names are known, and the log frequencies of those."""
        keys, table = self.levels[level]
        if not len(keys) or not names:
            return np.zeros(len(names), bool), table[:0]
        hashes = np.fromiter((xxhash.xxh64_intdigest(n.encode(), _SEED) for n in names), np.uint64, len(names)).view(np.int64)
        place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        hit = keys[place] == hashes
        return hit, table[place[hit]]

    def words(self, words: list[str]) -> np.ndarray:
        """Each word's log frequency in each language: its own if it is known, or else the mean of its longest known n-grams; zeros without any."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        hit, found = self._known(0, words)
        out[hit] = found
        left = np.flatnonzero(~hit)
        for size in range(len(self.levels) - 1, 0, -1):
            if not len(left):
                break
            grams = [_grams(words[k], size) for k in left]
            owner = np.repeat(np.arange(len(left)), [len(g) for g in grams])
            hit, found = self._known(size, [g for own in grams for g in own])
            n = np.bincount(owner[hit], minlength=len(left))
            for k in range(len(self.languages)):
                out[left, k] = np.bincount(owner[hit], found[:, k], len(left)) / np.maximum(n, 1)
            left = left[n == 0]
        return out


def _grams(word: str, size: int) -> list[str]:
    padded = f" {word} "
    return [padded[k : k + size] for k in range(len(padded) - size + 1) if padded[k : k + size] != " "]


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = MOST_ROWS, longest: int = LONGEST_GRAM) -> Model:
    """A model of the words of labelled rows.

    Reads about most_rows rows (by a hash of the id, so any order gives the same ones) of those that are `usable`
    and have a language; the bound is shared among the languages by shares(). All words of these rows and all their n-grams count: Spark adds
    them up, and only their hashes and counts come to the driver. Null texts have no word, repeated rows count
    each, and an empty table (or one without languages) gives a model that knows none.
    """
    rows = docs.filter(usable & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.lit("language"), id_col), F.lit(1 << 40)).alias("draw"))
    there = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if sum(there.values()) > most_rows:
        limit = [(F.col("lang") == lang) & (F.col("draw") < int((1 << 40) * (n / there[lang]))) for lang, n in shares(there, most_rows).items()]
        rows = rows.filter(functools.reduce(operator.or_, limit))
    languages = sorted(there)
    words = F.explode(F.regexp_extract_all(F.lower(F.col("text")), F.lit(r"\p{L}+"), F.lit(0)))
    counts = written(rows.select(F.array_position(F.array(*map(F.lit, languages)).cast("array<string>"), F.col("lang")).cast("int").alias("lang"), words.alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))

    def of_size(size: int) -> Column:
        named = F.transform(F.sequence(F.lit(1), F.length("word") + (3 - size)), lambda k: F.struct(F.lit(size).alias("level"), F.xxhash64(F.substr(padded, k, F.lit(size))).alias("key")))
        return F.when(F.length("word") + 2 >= size, named).otherwise(F.array().cast("array<struct<level:int,key:bigint>>"))

    grams = counts.select("lang", "n", F.explode(F.concat(*map(of_size, range(1, longest + 1)))).alias("g")).filter(F.col("g.key") != F.xxhash64(F.lit(" "))).groupBy("g.level", "g.key", "lang").agg(F.sum("n").alias("n"))
    own = counts.select(F.lit(0).alias("level"), F.xxhash64("word").alias("key"), "lang", "n")
    found = own.unionByName(grams).toArrow()
    level, key, lang, n = (found.column(c).to_numpy() for c in ("level", "key", "lang", "n"))
    levels = []
    for k in range(longest + 1):
        own = level == k
        keys, place = np.unique(key[own], return_inverse=True)
        table = np.zeros((len(keys), len(languages)), np.float32)
        np.add.at(table, (place, lang[own] - 1), n[own])
        levels.append((keys, table))
    return Model(languages, levels)


def shares(there: dict[str, int], most: int) -> dict[str, int]:
    """How many of its own each language may have, so that together they have `most`: small ones keep all, the others as many as each other (1 at least)."""
    found, left = {}, most
    for k, lang in enumerate(sorted(there, key=lambda lang: (there[lang], lang))):
        found[lang] = min(there[lang], max(1, left // (len(there) - k)))
        left -= found[lang]
    return found


class Scorer:
    """Sums of word scores for whole texts; a slice's distinct chunks are scored together, and a bounded number of them is kept."""

    def __init__(self, model: Model):
        self.model = model
        self.places: dict[str, int] = {}
        self.kept = np.zeros((MOST_CHUNKS, len(model.languages) + 1), np.float32)

    def _chunks(self, chunks: list[str]) -> np.ndarray:
        """For each chunk, each language's score and how many words there are."""
        width = len(self.model.languages)
        out = np.zeros((len(chunks), width + 1), np.float32)
        places: dict[str, int] = {}
        owner, word = [], []
        for k, chunk in enumerate(chunks):
            for w in _WORD.findall(chunk.lower()):
                owner.append(k)
                word.append(places.setdefault(w, len(places)))
        if word:
            logs, owner = self.model.words(list(places))[word], np.array(owner)
            for k in range(width):
                out[:, k] = np.bincount(owner, logs[:, k], len(chunks))
            out[:, width] = np.bincount(owner, minlength=len(chunks))
        return out

    def _scores(self, values: list[str]) -> np.ndarray:
        place = np.fromiter((self.places.get(v, -1) for v in values), np.int64, len(values))
        fresh = np.flatnonzero(place < 0)
        out = self.kept[place]
        if len(fresh):
            out[fresh] = self._chunks([values[k] for k in fresh])
            free = fresh[: MOST_CHUNKS - len(self.places)]
            at = len(self.places)
            self.kept[at : at + len(free)] = out[free]
            self.places.update((values[k], at + i) for i, k in enumerate(free))
        return out.astype(np.float64)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        cut = Chunks(texts)
        sums = cut.sums(self._scores(cut.values))
        scores, words = sums[:, :-1], sums[:, -1]
        if not self.model.languages:
            return [UNKNOWN] * len(words), np.zeros(len(words))
        best = scores.argmax(axis=1)
        odds = np.exp(np.clip(scores - scores.max(axis=1, keepdims=True), -700, 0))
        names = [self.model.languages[b] if n else UNKNOWN for b, n in zip(best, words, strict=True)]
        return names, np.where(words > 0, 1 / odds.sum(axis=1), 0.0)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id_col, lang_pred, score (posterior of that language, 0 to 1).

    A text that is null or has no letter is `und` with score 0, as is any text
    if nothing was learned. Languages that score alike: the first by name. Repeated rows are judged each and alike, and an empty table gives no rows.
    Whole texts are read; other columns aren't. No shuffle; the model is that of the rows that train() reads.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            for part in slices(batch, "text"):
                scorer = scorer or Scorer(shared.value)
                names, scores = scorer.predict(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(kernel, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
