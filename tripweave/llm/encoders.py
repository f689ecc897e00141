"""Token ids of whole texts with the `tokenizers` library, one distinct chunk at a time.

The pre-tokenizers of the two vocabulary files cut a text so that chunks
between spaces can be encoded alone, but for the cases that `_alone` names;
documents with such a chunk are encoded whole by the library. The words' merges
are always the library's.
"""

from __future__ import annotations

import functools
import os
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex

from tripweave.llm.chunks import Chunks, Memo

# The pre-tokenizers' patterns, as the vocabulary files state them.
SPACED_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BARE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; a path is taken as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Ids of texts for a byte-level file (`spaced`) or a lower-casing file with word ends."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.spaced = self.tokenizer.normalizer is None
        self.pattern = regex.compile(SPACED_WORDS if self.spaced else BARE_WORDS)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = os.path.commonprefix(self.special) or None
        self.letters = byte_letters()
        self.words = Memo(self._word, 200_000)
        self.memo = Memo(functools.partial(self._alone, spaced=" " if self.spaced else ""), 600_000)
        self.first = Memo(functools.partial(self._alone, spaced=""), 50_000)

    def _word(self, word: str) -> tuple[int, ...]:
        if word.isascii() and word[1:].isalnum() and (word[0] == " " or word[0].isalnum()):
            shown = "\u0120" + word[1:] if word[0] == " " else word
        else:
            shown = word.encode().decode("latin-1").translate(self.letters)
        return tuple([t.id for t in self.model.tokenize(shown)])

    def _alone(self, chunk: str, spaced: str) -> bytes | None:
        """Ids (4 bytes each) of a chunk between spaces, or None where its neighbours matter.

        Space beside a space joins into one word of spaces, and a special
        token's text may be cut by a space: both need the whole document.
        """
        if self.mark and self.mark in chunk:
            return None
        if self.spaced:
            if chunk[:1].isspace() or chunk[-1:].isspace() or (not chunk and spaced):
                return None
            text = spaced + chunk
        elif chunk.isascii():
            text = chunk.lower()
        elif unicodedata.combining(chunk[0]) or not chunk.replace("\n", "").isprintable():
            return None
        else:
            text = "".join([c.lower() for c in unicodedata.normalize("NFC", chunk)])
        words = self.words
        return array("I", [i for w in self.pattern.findall(text) for i in words[w]]).tobytes()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: pa.Array, end: int | None = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (nulls as empty; each followed by `end`), and how many each has."""
        return self._spread(texts, Chunks(texts), end)

    def _spread(self, texts: pa.Array, cut: Chunks, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        per_value = list(map(self.memo.__getitem__, cut.values))
        odd = np.array([x is None for x in per_value], bool)
        flat = [x for x in per_value if x is not None]
        sizes = np.array([0 if x is None else len(x) // 4 for x in per_value], np.int64)
        codes = cut.codes
        # In a spaced file a document's first chunk differs: no space stands before it.
        heads = {d: self.first[cut.values[codes[s]]] for d, s in enumerate(cut.starts)} if self.spaced else {}
        tail = [] if end is None else [end]
        places = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
        pool = np.frombuffer(b"".join(flat), np.uint32)
        chunk_sizes = sizes[codes]
        if self.spaced:
            chunk_sizes[cut.starts] = 0
        total = np.cumsum(chunk_sizes)
        source = np.repeat(places[codes] - (total - chunk_sizes), chunk_sizes) + np.arange(total[-1] if len(total) else 0)
        body = pool[source]
        bounds = np.concatenate(([0], total[np.append(cut.starts[1:], len(codes)) - 1])) if len(cut.starts) else np.zeros(1, np.int64)
        is_odd = odd[codes]
        if self.spaced:
            is_odd[cut.starts] = False
        whole = np.logical_or.reduceat(is_odd, cut.starts) if len(cut.starts) else np.zeros(0, bool)
        parts, counts = [], []
        for d in range(len(cut.starts)):
            head = heads.get(d) if self.spaced else b""
            if whole[d] or head is None:
                ids = [self.whole(texts[d].as_py() or "")]
            else:
                ids = [np.frombuffer(head, np.uint32), body[bounds[d] : bounds[d + 1]]]
            ids.append(np.array(tail, np.uint32))
            parts += ids
            counts.append(sum(map(len, ids)))
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), np.array(counts, np.int64)


@functools.lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    """One encoder for each worker process, kept with its memo between tasks."""
    return Encoder(vocabulary(name))


def crc32(ids: np.ndarray) -> int:
    """Unsigned CRC of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
