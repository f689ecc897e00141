"""Token counts of a unigram tokenizer, without making the tokens."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.chunks import Chunks, Memo, slices
from tripweave.llm.encoders import vocabulary

MARK = "▁"
#: Fixed value: what the tokenizer takes off its least score for a character outside the vocabulary.
UNKNOWN_PENALTY = 10.0


def piece_scores(name: str) -> list[tuple[str, float]]:
    """The pieces of a SentencePiece file with the scores that it states."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(name))
    return [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())]


class Counter:
    """Counts the pieces of the best segmentation of each word (a mark and what follows up to the next one).

    The automaton gives all vocabulary pieces that end at a place, longest first. As
    the tokenizer does, the best score so far is replaced only by a greater one, so
    of equal ones the piece that starts first stays; a character that is no piece costs
    the least score less UNKNOWN_PENALTY, is considered after the pieces, and counts its UTF-8 bytes.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.singles = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.words = Memo(self._word)
        self.memo = Memo(self._later)

    def _word(self, word: str) -> tuple[int, int]:
        n = len(word)
        score, count, in_bytes, reached = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        done = 0  # places up to here have their unknown character, which follows the pieces that end there
        reached[0] = True

        def close(upto: int) -> None:
            nonlocal done
            while done < upto:
                done += 1
                c = word[done - 1]
                if c not in self.singles and (not reached[done] or score[done - 1] + self.unknown > score[done]):
                    score[done], reached[done] = score[done - 1] + self.unknown, True
                    n_bytes = len(c.encode())
                    count[done], in_bytes[done] = count[done - 1] + n_bytes, in_bytes[done - 1] + n_bytes

        for last, (length, own) in self.automaton.iter(word):
            end = last + 1
            close(end - 1)
            found = score[end - length] + own
            if not reached[end] or found > score[end]:
                score[end], reached[end], count[end], in_bytes[end] = found, True, count[end - length] + 1, in_bytes[end - length]
        close(n)
        return count[n], in_bytes[n]

    def _cut(self, marked: str) -> tuple[int, int]:
        """A text whose spaces are marks, cut before each mark."""
        head, *rest = marked.split(MARK)
        found = [self.words[w] for w in ([head] if head else [])] + [self.words[MARK + w] for w in rest]
        return sum(f[0] for f in found), sum(f[1] for f in found)

    def _later(self, chunk: str) -> tuple[int, int]:
        return self._cut(MARK + chunk)

    def _first(self, chunk: str) -> tuple[int, int]:
        if not chunk:
            return (0, 0)  # a text that starts with a space (or is empty) gets no mark of its own
        return self._cut(chunk) if chunk.startswith(MARK) else self._later(chunk)

    def count(self, texts: pa.Array) -> np.ndarray:
        """(pieces, of them bytes) for each text; nulls count as empty."""
        cut = Chunks(texts)
        per_value = np.array([self.memo[v] for v in cut.values], np.int64).reshape(-1, 2)
        sums = cut.sums(per_value)
        for d, s in enumerate(cut.starts):
            code = cut.codes[s]
            sums[d] += np.array(self._first(cut.values[code])) - per_value[code]
        return sums


@functools.lru_cache(maxsize=1)
def counter(name: str) -> Counter:
    """One counter for each worker process, kept with its memo between tasks."""
    return Counter(piece_scores(name))


def token_counts(docs: DataFrame, vocabulary_name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id_col, n_tokens, n_byte_tokens (long), over whole texts.

    A null or empty text has no token; repeated rows are counted each; other columns aren't
    read. No shuffle; a task holds a slice of texts and two bounded memos.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = counter(vocabulary_name).count(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found[:, 0]), pa.array(found[:, 1])], names=["id", "n_tokens", "n_byte_tokens"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(kernel, f"id {kind}, n_tokens long, n_byte_tokens long").withColumnRenamed("id", id_col)
