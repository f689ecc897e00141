"""Near-duplicate documents by 64-bit SimHash fingerprints."""

from __future__ import annotations

import collections
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm.chunks import release
from tripweave.operators.components import components
from tripweave.operators.joins import join_counted
from tripweave.sources.shared import written

SHINGLE_WORDS, SEED, MOST_BITS = 4, 42, 4
BYTES = 8
#: Two fingerprints that differ in so many bits agree in so many of their bytes at least: the guaranteed minimum of the tally.
LEAST_SHARED = BYTES - MOST_BITS


def _triples() -> list[tuple[int, ...]]:
    """Sets of three byte positions such that any LEAST_SHARED positions hold one of them (Turan's construction).

    The positions are dealt into three groups in a ring; a set lies in one group, or has two in one and one in the next.
    """
    group = [p * 3 // BYTES for p in range(BYTES)]
    kinds = lambda t: [sum(group[p] == g for p in t) for g in range(3)]
    return [t for t in itertools.combinations(range(BYTES), 3) if any(k == 3 or (k == 2 and kinds(t)[(g + 1) % 3] == 1) for g, k in enumerate(kinds(t)))]


#: The sets of byte positions by which postings are named, and those that lists of over LIST_LIMIT are dealt by again.
TRIPLES, FOURS = _triples(), list(itertools.combinations(range(BYTES), LEAST_SHARED))
#: Longer posting lists are dealt again by one more byte; lists of at most SHORT are compared without a loop over lists.
LIST_LIMIT, SHORT = 4_096, 16
#: Wide fingerprints have so many words of 64 bits; in a posting list by three bytes of a word, pairs whose words differ in more bits than WORD_BITS are chance.
WIDE, WORD_BITS = 8, 13
#: So many bits more or fewer than expected are three deviations of a wide fingerprint's distance.
SPREAD = 24
SIMILAR_WORDS, SIMILARITY = 5, 0.8
_BLOCK = 1 << 12
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_STEP, _MIX1, _MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _shingle_hashes(text: bytes | None, shingle_words: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of UTF-8 text, some at a time; A-Z count as a-z, words are runs of anything but ASCII white space."""
    words = (text or b"").lower().split()
    n = max(1, len(words) - shingle_words + 1) if words else 0
    for start in range(0, n, _BLOCK):
        part = words[start : min(start + _BLOCK, n) + shingle_words - 1]
        shingles = zip(*(part[i:] for i in range(shingle_words)), strict=False) if len(words) >= shingle_words else [words]
        yield np.array([xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, shingles)], "<u8")


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes (a row of words each) set each bit, from counts of the values of each byte."""
    byte = hashes.view(np.uint8).reshape(len(hashes), -1)
    counts = np.bincount((byte + 256 * np.arange(byte.shape[1])).ravel(), minlength=256 * byte.shape[1])
    return (counts.reshape(-1, 256) @ _BITS).ravel()


def _fingerprint(text: bytes | None, shingle_words: int, words: int) -> bytes:
    ones, n = np.zeros(64 * words, np.int64), 0
    for hashes in _shingle_hashes(text, shingle_words):
        wide = hashes[:, None] + np.arange(words, dtype=np.uint64) * _STEP
        if words > 1:  # further words are what a mixer makes of the hash
            z = (wide ^ (wide >> np.uint64(30))) * _MIX1
            z = (z ^ (z >> np.uint64(27))) * _MIX2
            wide = np.where(np.arange(words) > 0, z ^ (z >> np.uint64(31)), wide)
        ones += _ones(np.ascontiguousarray(wide))
        n += len(hashes)
    return np.packbits(ones * 2 > n, bitorder="little").tobytes()


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of UTF-8 text: a bit is 1 if over half of the shingles' hashes set it; without a word all are 0."""
    return int.from_bytes(_fingerprint(text, shingle_words, 1), "little")


def wide_fingerprint(text: bytes | None, shingle_words: int = SIMILAR_WORDS) -> bytes:
    """The same of WIDE words: the first from the shingles' hashes, each other from another mix of them."""
    return _fingerprint(text, shingle_words, WIDE)


def _of_texts(docs: DataFrame, id_col: str | Column, text_col: str, work: Callable[[pa.Array], pa.Array], kind: str) -> DataFrame:
    """(id, fp): what work makes of each batch of UTF-8 texts."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary() if pa.types.is_large_string(batch.column(1).type) else pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), work(texts)], names=["id", "fp"])
        release()

    rows = docs.select((F.col(id_col) if isinstance(id_col, str) else id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(kernel, f"id {rows.schema['id'].dataType.simpleString()}, fp {kind}")


def fingerprints(docs: DataFrame, id_col: str | Column = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp): each row's fingerprint as a signed 64-bit integer. Null texts count as empty (0)."""
    return _of_texts(docs, id_col, text_col, lambda texts: pa.array(np.array([fingerprint(t.as_py(), shingle_words) for t in texts], np.uint64).view(np.int64)), "long")


def _names(fp: str, sets: list[tuple[int, ...]]) -> list[Column]:
    """The byte values of a fingerprint at each set of positions, with the set's number, as one 64-bit name each."""
    byte = [F.shiftrightunsigned(F.col(fp), 8 * i).bitwiseAND(F.lit(255)) for i in range(BYTES)]
    names = []
    for k, positions in enumerate(sets):
        name = F.lit(k).cast("long")
        for p in positions:
            name = F.shiftleft(name, 8).bitwiseOR(byte[p])
        names.append(name)
    return names


def tally(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """How many positional bytes each two fingerprints share."""
    return ((a ^ b).view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)


def near(a: np.ndarray, b: np.ndarray | np.uint64, most_bits: int = MOST_BITS) -> np.ndarray:
    """Which pairs of a posting list reach the guaranteed number of shared bytes and then, verified, differ in few bits."""
    found = tally(a, b) >= BYTES - most_bits
    found[found] = np.bitwise_count((a ^ b)[found]) <= most_bits
    return found


def _forest(fps: np.ndarray, most_bits: int) -> tuple[list, list]:
    """Links that join what one posting list's pairs would join, one for each fingerprint reached."""
    left = fps
    a, b = [], []
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            one = reached.pop()
            hit = near(left, one, most_bits)
            if hit.any():
                found = left[hit]
                a += [one] * len(found)
                b += found.tolist()
                reached += list(found)
                left = left[~hit]
    return a, b


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows ordered by name, as (names, fingerprints, True) of whole lists or (names, fingerprints, False) of a part of one beyond LIST_LIMIT."""
    names, fps, cut = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
    for batch in batches:
        more, values = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        names, fps = np.concatenate([names, more]), np.concatenate([fps, values.view(np.uint64)])
        if cut is not None:  # goes on with a list that is too long
            k = int(np.searchsorted(names, cut, side="right"))
            if k:
                yield names[:k], fps[:k], False
            names, fps = names[k:], fps[k:]
        if not len(names):
            continue
        cut = None
        last = int(np.searchsorted(names, names[-1]))
        yield names[:last], fps[:last], True
        names, fps = names[last:], fps[last:]
        if len(names) > LIST_LIMIT:
            yield names, fps, False
            names, fps, cut = names[:0], fps[:0], names[0]
    yield names, fps, True


def _linked(names: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (a, b) of whole posting lists, and which rows are in lists that are too long for it."""
    starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(names)))
    size = np.repeat(sizes, sizes)
    links = []
    short = np.flatnonzero(size <= SHORT)
    for off in range(1, SHORT):
        first = short[(short + off < len(names))]
        first = first[names[first] == names[np.minimum(first + off, len(names) - 1)]]
        if not len(first):
            break
        hit = near(fps[first], fps[first + off])
        links.append((fps[first][hit], fps[first + off][hit]))
    for k in np.flatnonzero((sizes > SHORT) & (sizes <= LIST_LIMIT)):
        a, b = _forest(np.unique(fps[starts[k] : starts[k] + sizes[k]]), MOST_BITS)
        links.append((np.array(a, np.uint64), np.array(b, np.uint64)))
    a, b = (np.concatenate([x[k] for x in links] or [np.zeros(0, np.uint64)]) for k in (0, 1))
    return a, b, size > LIST_LIMIT


def _free_masks(name: int, most_bits: int) -> np.ndarray:
    """Changes of at most half of most_bits bits outside the byte positions that a posting list has in common."""
    free = [8 * p + k for p in range(BYTES) if p not in FOURS[int(name) >> (8 * LEAST_SHARED)] for k in range(8)]
    sets = itertools.chain.from_iterable(itertools.combinations(free, r) for r in range(most_bits // 2 + 1))
    return np.array([sum(1 << k for k in s) for s in sets], np.uint64)


def _search(postings: DataFrame) -> DataFrame:
    """(a, b, name) from postings (name, fp): links within lists, and (fp, null, name) of the members of lists beyond LIST_LIMIT."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
        for names, fps, whole in _lists(batches):
            a, b, long = _linked(names, fps) if whole else (fps[:0], fps[:0], np.ones(len(fps), bool))
            if len(a):
                yield pa.RecordBatch.from_arrays([longs(a), longs(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "name"])
            if long.any():
                yield pa.RecordBatch.from_arrays([longs(fps[long]), pa.nulls(int(long.sum()), pa.int64()), pa.array(names[long])], names=["a", "b", "name"])

    n = max(int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return written(postings.repartition(n, "name").sortWithinPartitions("name").mapInArrow(kernel, "a long, b long, name long"), "links")


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` at MOST_BITS or fewer differing bits.

    Not every pair is given, but those joined by pairs are joined by links.

    A single byte's posting list would hold 1/256 of all fingerprints, so the index names postings by three
    positional bytes: 20 such sets are enough that any pair with the guaranteed minimum of LEAST_SHARED common bytes
    meets in a list. Members of a list may share no more than those three: the pairs' shared bytes are
    tallied over all positions, those below the minimum go, and the rest are verified bit by bit. A list of more than SHORT is
    worked off as a search from member to member that drops each one reached, so a dense list
    costs little more than its length and gives a link less than it has members.

    A list of over LIST_LIMIT (hot bytes) isn't gathered: a pair that reaches the minimum shares a fourth byte too, so its members are dealt by
    each fourth byte. Where even four bytes are shared by more than LIST_LIMIT, each member names all fingerprints within half the
    distance that the list allows, and members with a common neighbour are linked to the least of them: two
    fingerprints have one exactly if they are within the full distance.
    """

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, fps = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for name in np.unique(names):
                masks, own = _free_masks(name, MOST_BITS), fps[names == name].view(np.uint64)
                for start in range(0, len(own), 1000):
                    part = own[start : start + 1000]
                    yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ masks).ravel().view(np.int64)), pa.array(np.repeat(part, len(masks)).view(np.int64))], names=["near", "fp"])

    found = _search(distinct.select(F.explode(F.array(*_names("fp", TRIPLES))).alias("name"), "fp"))
    pairs, long = found.filter("b is not null").select("a", "b"), found.filter("b is null")
    if long.isEmpty():
        return pairs
    # The fours that hold a list's triple; lists of different triples may lead to one four.
    fours = _names("a", FOURS)
    triple = F.shiftright("name", 24)
    again = F.filter(F.array(*(F.when(triple.isin([k for k, t in enumerate(TRIPLES) if set(t) <= set(four)]), fours[j]) for j, four in enumerate(FOURS))), lambda x: x.isNotNull())
    found = _search(long.select(F.explode(again).alias("name"), F.col("a").alias("fp")).distinct())
    pairs, long = pairs.union(found.filter("b is not null").select("a", "b")), found.filter("b is null")
    if long.isEmpty():
        return pairs
    around = written(long.select("name", "a").mapInArrow(neighbours, "near long, fp long").distinct(), "neighbours")
    centre = around.groupBy("near").agg(F.min("fp").alias("b"))
    return pairs.union(around.join(centre, "near").filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct())


def near_components(docs: DataFrame, id_col: str | Column = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp, component_id, component_size) of each row; id_col may be a column of its own, such as a struct."""
    rows = written(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")).withColumn("node", F.col("fp")), "distinct")
    return _grouped(rows, distinct, links(distinct.select("fp")))


def _grouped(rows: DataFrame, distinct: DataFrame, found: DataFrame) -> DataFrame:
    """(id, fp, component_id, component_size) of rows (id, fp) from their distinct fingerprints (fp, least, n, node) and the links (a, b) between nodes.

    Fingerprints of many rows and components of many fingerprints are joined by join_counted(), so no task gathers them.
    """
    named = components(found).withColumnRenamed("node", "named")
    parts = written(distinct.join(named, F.col("node") == F.col("named"), "left").select("fp", "least", "n", "component"), "parts")
    linked, alone = parts.filter("component is not null"), parts.filter("component is null")
    whole = written(linked.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size"), F.count("*").alias("members")), "whole")
    ids = join_counted(linked.select("fp", "component", "n"), whole, ["component"], "members").select("fp", "component_id", "component_size", "n")
    ids = written(ids.union(alone.select("fp", "least", "n", "n")), "components")
    return join_counted(rows, ids, ["fp"], "n").select("id", "fp", "component_id", "component_size")


def most_bits(similarity: float) -> int:
    """In how many bits wide fingerprints of texts may differ whose sets of shingles have that similarity (Jaccard): the angle of such sets, of equal size, over pi."""
    return math.floor(64 * WIDE * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def _sizes(names: np.ndarray) -> np.ndarray:
    """For each of ordered names how many times it is there."""
    starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(names)))
    return np.repeat(sizes, sizes)


def _collapsed(names: np.ndarray, words: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates (a, b) between rows of one name and word, each with the first of them, and which rows are first; rows are ordered by name and word."""
    first = np.concatenate([[True], (names[1:] != names[:-1]) | (words[1:] != words[:-1])]) if len(names) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(first, np.arange(len(names)), 0))
    return nodes[head[~first]], nodes[~first], first


def _alike(names: np.ndarray, words: np.ndarray, nodes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates (a, b) of whole posting lists by three bytes of a word, in which no word is twice: links that join what pairs join whose words are nearer than chance.

    A list gives less candidates than it has members, and each list starts from its least nodes, so the lists that a large group of like texts fills name mostly the same ones.
    """
    starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(names)))
    two = starts[sizes == 2]
    two = two[np.bitwise_count(words[two] ^ words[two + 1]) <= WORD_BITS]
    yield nodes[two], nodes[two + 1]
    for k in np.flatnonzero(sizes > 2):
        part = slice(starts[k], starts[k] + sizes[k])
        order = np.argsort(nodes[part])
        own, of = words[part][order], nodes[part][order]
        left, a, b = np.arange(len(own)), [], []
        while len(left) > 1:
            reached, left = collections.deque([left[0]]), left[1:]
            while reached and len(left):
                one = reached.popleft()
                hit = np.bitwise_count(own[left] ^ own[one]) <= WORD_BITS
                if hit.any():
                    found = left[hit]
                    a += [one] * len(found)
                    b += found.tolist()
                    reached += found.tolist()
                    left = left[~hit]
        if a:
            yield of[a], of[b]


def similar_links(distinct: DataFrame, texts: DataFrame, shingle_words: int = SIMILAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between nodes whose texts have that similarity: the Jaccard similarity of their sets of shingles. distinct has node, fp (wide) and least; texts id and text.

    The byte-position index of links(), for each of the WIDE words: a pair of similar texts shares three positional bytes that name a list in one word
    or another, and such lists are long only where texts are alike. In a list the words are compared (equal ones are linked to the first, others within WORD_BITS), and
    every candidate is verified over all bits. A list of more than LIST_LIMIT different words isn't held by a task: it is dealt into blocks, and every two blocks are compared in one. Those that differ in SPREAD bits fewer than the similarity lets expect are similar beyond doubt, those with SPREAD
    more aren't; in between the sets of shingles are compared, for which the texts of these candidates alone are read again. A pair at
    the limit is missed by all words in about one case of seven, a more similar one far more rarely; both are mostly joined by a third.
    """
    expected = most_bits(similarity)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            byte = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, 8 * WIDE).astype(np.int64)
            for j in range(WIDE):
                word = pa.array(np.ascontiguousarray(byte[:, 8 * j : 8 * j + 8].astype(np.uint8)).view(np.int64).ravel())
                for k, (p, q, r) in enumerate(TRIPLES):
                    name = (j * len(TRIPLES) + k) << 24 | byte[:, 8 * j + p] << 16 | byte[:, 8 * j + q] << 8 | byte[:, 8 * j + r]
                    yield pa.RecordBatch.from_arrays([pa.array(name), word, batch.column(0)], names=["name", "word", "node"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, null, null) of lists up to LIST_LIMIT different words, and (node, null, name, word) of the different words of longer ones."""
        none = lambda n: pa.nulls(n, pa.int64())
        names = ["a", "b", "name", "word"]
        held, cut = [np.zeros(0, np.int64)] * 3, None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held = [np.concatenate([h, batch.column(k).to_numpy(zero_copy_only=False)]) for k, h in enumerate(held)]
            a, b, first = _collapsed(*held)  # equal words are linked to the first of them, which alone stays
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none(len(a)), none(len(a))], names=names)
            held = [h[first] for h in held]
            last = len(held[0]) if batch is None else int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            whole, held = [h[:last] for h in held], [h[last:] for h in held]
            size = _sizes(whole[0])
            long = (size > LIST_LIMIT) | (whole[0] == cut) if cut is not None else size > LIST_LIMIT
            for a, b in _alike(whole[0][~long], whole[1][~long].view(np.uint64), whole[2][~long]):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none(len(a)), none(len(a))], names=names)
            name, word, node = (x[long] for x in whole)
            if len(held[0]) > LIST_LIMIT or (len(held[0]) > 1 and held[0][0] == cut):  # goes on; its last word stays, as equal ones may follow
                cut = held[0][0]
                name, word, node = (np.concatenate([x, h[:-1]]) for x, h in zip((name, word, node), held, strict=True))
                held = [h[-1:] for h in held]
            if len(name):
                yield pa.RecordBatch.from_arrays([pa.array(node), none(len(node)), pa.array(name), pa.array(word)], names=names)
        release()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates of the squares of long lists; a square's rows come together and are as many as two blocks hold."""
        held = [np.zeros(0, np.int64)] * 3
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held = [np.concatenate([h, batch.column(k).to_numpy(zero_copy_only=False)]) for k, h in enumerate(held)]
            last = len(held[0]) if batch is None else int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            whole, held = [h[:last] for h in held], [h[last:] for h in held]
            for a, b in _alike(whole[0], whole[1].view(np.uint64), whole[2]):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        release()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, WIDE) for k in (2, 3))
            differ = np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64)
            near = pa.array(differ <= expected + SPREAD)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).filter(near) for k in (0, 1)), pa.array(differ <= expected - SPREAD).filter(near)], names=["a", "b", "sure"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.concatenate([np.zeros(0, "<u8"), *_shingle_hashes((t.as_py() or "").encode(), shingle_words)])).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "hashes"])
        release()

    n = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    postings = distinct.select("node", "fp").mapInArrow(post, "name long, word long, node long")
    searched = postings.repartition(n, "name").sortWithinPartitions("name", "word", "node").mapInArrow(search, "a long, b long, name long, word long")
    searched = written(searched, "searched")
    found, long = searched.filter("b is not null").select("a", "b"), searched.filter("b is null")
    if not long.isEmpty():
        # Every two blocks of a long list, and with them every two of its words, are compared in a square.
        lists = written(long.groupBy("name").agg(F.ceil(F.count("*") / (LIST_LIMIT // 2)).cast("int").alias("blocks")), "lists")
        rows = long.join(lists, "name").withColumn("own", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        square = F.xxhash64("name", F.least("own", "other"), F.greatest("own", "other"))
        squares = rows.select(square.alias("square"), "word", F.col("a").alias("node"))
        found = found.union(squares.repartition(n, "square").sortWithinPartitions("square", "word", "node").mapInArrow(compare, "a long, b long"))
    found = written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    found = written(_at_ends(found, distinct.select("node", "fp")).mapInArrow(verify, "a long, b long, sure boolean"), "verified")
    sure, open_ = found.filter("sure").select("a", "b"), found.filter("not sure").select("a", "b")
    if open_.isEmpty():
        return sure
    wanted = open_.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(distinct.select("node", "least"), "node")
    read = texts.join(written(wanted, "wanted"), F.col("id").eqNullSafe(F.col("least"))).select("node", "text").dropDuplicates(["node"])
    hashed = written(read.mapInArrow(sets, "node long, hashes array<bigint>"), "shingles")
    shared = F.size(F.array_intersect("hashes_a", "hashes_b"))
    alike = shared >= similarity * (F.size("hashes_a") + F.size("hashes_b") - shared)
    return sure.union(_at_ends(open_, hashed).filter(alike).select("a", "b"))


def _at_ends(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Written pairs (a, b) with the values (node, value) of both ends; a text that is alike to many is an end of many pairs."""
    value = values.columns[1]
    ends = {}
    for end in ("a", "b"):
        counts = pairs.groupBy(end).agg(F.count("*").alias("_n"))
        ends[end] = written(counts.join(values.select(F.col("node").alias(end), F.col(value).alias(f"{value}_{end}")), end), "ends")
    pairs = written(join_counted(pairs, ends["a"], ["a"], "_n"), "ends")  # else what reads the result would join again
    return join_counted(pairs, ends["b"], ["b"], "_n").select("a", "b", f"{value}_a", f"{value}_b")


def similar_components(docs: DataFrame, id_col: str | Column = "doc_id", text_col: str = "text", shingle_words: int = SIMILAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(id, component_id, component_size) of each row: components of texts whose sets of shingles are similar, found by wide SimHash fingerprints.

    As in near_duplicates(): null and empty texts have fingerprint zero, repeated rows give repeated results, a null id is
    the smallest of a component only without another, an empty table gives no rows, other columns aren't read. id_col may be a column of its own, such as a struct.
    """
    wide = lambda texts: pa.array([wide_fingerprint(t.as_py(), shingle_words) for t in texts], pa.binary())
    rows = written(_of_texts(docs, id_col, text_col, wide, "binary"), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id())
    distinct = written(distinct, "distinct")  # the number is fixed from here on
    texts = docs.select((F.col(id_col) if isinstance(id_col, str) else id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return _grouped(rows, distinct, similar_links(distinct, texts, shingle_words, similarity)).select("id", "component_id", "component_size")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Each document's fingerprint and the component of linked documents it belongs to.

    Returns id_col, fingerprint (16 hex digits), component_id (smallest id
    reachable over links of MOST_BITS bits, its own included), component_size.

    Null and empty texts and texts of white space have fingerprint zero and are
    linked like any other; repeated rows give repeated results; a null id is
    never the smallest unless a component has no other. Other columns are not
    read. Texts are hashed once; after that only 16 bytes a document move.
    """
    rows = near_components(docs, id_col, text_col, shingle_words)
    return rows.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")
