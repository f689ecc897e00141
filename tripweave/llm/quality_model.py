"""Quality scores by a factorisation machine over hashed words and the text's structure."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm.chunks import Chunks, Memo, slices

#: Bounds of the model: labelled rows that are read, buckets of hashed words, length of the factors.
MOST_ROWS, BUCKETS, FACTORS = 12_000, 1 << 14, 4
STEPS, BATCH, RATE, DECAY, SEED = 1500, 64, 0.02, 1e-5, 11
#: Character classes whose shares of a text are features.
CLASSES = (r"\p{L}", r"\p{Lu}", r"\p{N}", r"[#*$%&|<>]", r"[.,;:!?]", r"\n")
#: Numbers of a text's structure, and of its metadata (three).
STRUCTURE = len(CLASSES) + 6 + 3
#: The table's own columns that a score may use.
METADATA = "n_chars"


class Features:
    """For each text, the hashed words it has with their weights, and numbers of its structure (0 to about 1).

    Word weights are counts over the root of the sum of their squares. Structure: shares of
    character classes, mean chunk length, share of distinct chunks, share of repeated
    lines, lengths in characters, words and lines (logarithms). Metadata: the stated number of characters (logarithm), by how much
    it is off, and whether none is stated.
    """

    def __init__(self):
        self.memo = Memo(self._bucket)

    @staticmethod
    def _bucket(chunk: str) -> int:
        return zlib.crc32(chunk.strip(".,;:!?\n").lower().encode()) % BUCKETS

    def __call__(self, texts: pa.Array, stated: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(documents, buckets, weights) of the hashed words, ordered by document, and the structure (a row per text)."""
        texts = pc.fill_null(texts, "")
        cut = Chunks(texts)
        n = len(cut.starts)
        doc = np.repeat(np.arange(n), cut.counts)
        buckets = np.array([self.memo[v] for v in cut.values], np.int64)[cut.codes] if n else np.zeros(0, np.int64)
        keys, counts = np.unique(doc * BUCKETS + buckets, return_counts=True)
        docs, words = keys // BUCKETS, keys % BUCKETS
        norm = np.sqrt(np.bincount(docs, counts.astype(float) ** 2, n))
        weights = counts / norm[docs]
        chars = np.maximum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), 1)
        shares = [pc.count_substring_regex(texts, pattern=p).to_numpy(zero_copy_only=False) / chars for p in CLASSES]
        lines = pc.split_pattern(texts, "\n")
        per_doc = pc.list_value_length(lines).to_numpy(zero_copy_only=False)
        coded = lines.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        line_doc = np.repeat(np.arange(n), per_doc)
        different = np.bincount(np.unique(line_doc * (coded.max(initial=0) + 1) + coded) // (coded.max(initial=0) + 1), minlength=n)
        distinct_words = np.bincount(docs, minlength=n)
        none = np.asarray(pc.is_null(stated))
        told = np.log1p(np.maximum(pc.fill_null(stated, 0).to_numpy(zero_copy_only=False).astype(np.float64), 0))
        metadata = [np.where(none, 0, told) / 12, np.where(none, 0, np.abs(told - np.log1p(pc.utf8_length(texts).to_numpy(zero_copy_only=False)))) / 12, none.astype(float)]
        structure = np.stack([*shares, np.minimum(chars / cut.counts / 20, 2), distinct_words / cut.counts, 1 - different / per_doc, np.log1p(chars) / 12, np.log1p(cut.counts) / 12, np.log1p(per_doc) / 12, *metadata], axis=1)
        return docs, words, weights, structure.astype(np.float64)


class FactorisationMachine:
    """Logistic model with a weight for each feature and, for each pair of features, the product of their factors."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.bias = 0.0
        self.linear = np.zeros(BUCKETS + STRUCTURE)
        self.factors = rng.normal(0, 0.01, (BUCKETS + STRUCTURE, FACTORS))
        self.mean, self.scale = np.zeros(STRUCTURE), np.ones(STRUCTURE)

    def rows(self, found: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features as (document, feature, value), structure standardised."""
        docs, words, weights, structure = found
        n = len(structure)
        scaled = np.clip((structure - self.mean) / self.scale, -5, 5) / np.sqrt(STRUCTURE)
        d = np.concatenate([docs, np.repeat(np.arange(n), STRUCTURE)])
        f = np.concatenate([words, np.tile(np.arange(STRUCTURE), n) + BUCKETS])
        return d, f, np.concatenate([weights, scaled.ravel()])

    def raw(self, d: np.ndarray, f: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic function, and each factor's sum: all pairs cost one pass over the features,
        since the sum over pairs is half the square of the sum less the sum of squares."""
        linear = np.bincount(d, self.linear[f] * x, n)
        sums, pairs = np.zeros((n, FACTORS)), np.zeros(n)
        for k in range(FACTORS):
            vx = self.factors[f, k] * x
            sums[:, k] = np.bincount(d, vx, n)
            pairs += 0.5 * (sums[:, k] ** 2 - np.bincount(d, vx**2, n))
        return self.bias + linear + pairs, sums

    def score(self, found: tuple) -> np.ndarray:
        n = len(found[3])
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.rows(found), n)[0], -30, 30)))

    def fit(self, found: tuple, labels: np.ndarray) -> FactorisationMachine:
        """Adam on the log loss with weight decay, STEPS batches or somewhat more; a fixed seed orders them."""
        structure = found[3]
        if not len(labels):
            return self
        self.mean, self.scale = structure.mean(axis=0), structure.std(axis=0) + 1e-6
        share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
        self.bias = float(np.log(share / (1 - share)))
        d, f, x = self.rows(found)
        order = np.argsort(d, kind="stable")
        d, f, x = d[order], f[order], x[order]
        ends = np.searchsorted(d, np.arange(len(labels) + 1))
        rng = np.random.default_rng(SEED)
        values = {"linear": self.linear, "factors": self.factors}
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in values.items()}
        step = 0
        while step < STEPS:
            for batch in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // BATCH)):
                step += 1
                sizes = ends[batch + 1] - ends[batch]
                at = np.repeat(ends[batch] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                bd, bf, bx = np.repeat(np.arange(len(batch)), sizes), f[at], x[at]
                raw, sums = self.raw(bd, bf, bx, len(batch))
                off = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[batch]) / len(batch)
                own, place = np.unique(bf, return_inverse=True)
                pull = off[bd] * bx
                grads = {"linear": np.bincount(place, pull, len(own)), "factors": np.stack([np.bincount(place, pull * (sums[bd, k] - self.factors[bf, k] * bx), len(own)) for k in range(FACTORS)], axis=1)}
                for name, grad in grads.items():
                    value, (m, v) = values[name], moments[name]
                    grad = grad + DECAY * value[own]
                    m[own] = 0.9 * m[own] + 0.1 * grad
                    v[own] = 0.999 * v[own] + 0.001 * grad**2
                    value[own] -= RATE * (m[own] / (1 - 0.9**step)) / (np.sqrt(v[own] / (1 - 0.999**step)) + 1e-8)
                self.bias -= RATE * off.sum()
        return self


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta_col: str = METADATA, most_rows: int = MOST_ROWS) -> FactorisationMachine:
    """A model fitted on about most_rows labelled rows (chosen by a hash of the id) of those that are `usable`.

    Features are worked out on the executors; the driver gets their numbers only, for that many rows at most.
    Rows without a label are ignored, and an id that occurs more often counts each time. A null text counts as empty, and a null (or absent) meta_col as
    not stated. With nothing to learn from all texts score alike.
    """
    marked = labels.filter(usable & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
    there = marked.count()
    if there > most_rows:
        marked = marked.filter(F.pmod(F.xxhash64(F.lit("quality"), "id"), F.lit(1 << 40)) < int((1 << 40) * (most_rows / there)))
    rows = _inputs(docs, id_col, text_col, meta_col).join(F.broadcast(marked), "id")  # at most about most_rows small rows

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for part in slices(batch, "text"):
                docs_, words, weights, structure = features(part.column(1), part.column(2))
                ends = np.searchsorted(docs_, np.arange(part.num_rows + 1)).astype(np.int32)
                as_list = lambda x, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(x, kind))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), as_list(words, pa.int32()), as_list(weights, pa.float32()), pa.array(list(structure), pa.list_(pa.float64()))], names=["id", "label", "words", "weights", "structure"])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(kernel, f"id {kind}, label double, words array<int>, weights array<float>, structure array<double>").toArrow().sort_by("id").combine_chunks()
    if not found.num_rows:
        return FactorisationMachine()
    flat = lambda c: found.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(found.column("words")).to_numpy()
    features = (np.repeat(np.arange(len(sizes)), sizes), flat("words").astype(np.int64), flat("weights").astype(np.float64), flat("structure").reshape(-1, STRUCTURE))
    return FactorisationMachine().fit(features, found.column("label").to_numpy())


def _inputs(docs: DataFrame, id_col: str, text_col: str, meta_col: str) -> DataFrame:
    stated = F.col(meta_col) if meta_col in docs.columns else F.lit(None)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), stated.cast("long").alias("stated"))


def score(docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text", meta_col: str = METADATA) -> DataFrame:
    """One row per row: id_col, score (0 to 1, higher: label 1 likelier).

    Whole texts of any length are scored, null ones as empty; repeated rows score alike; an empty table gives no rows. Only the text and
    meta_col are read. No shuffle.
    """
    rows = _inputs(docs, id_col, text_col, meta_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(features(part.column(1), part.column(2))))], names=["id", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(kernel, f"id {kind}, score double").withColumnRenamed("id", id_col)
