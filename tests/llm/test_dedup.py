from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash

from tripweave.llm import exact_dedup, oracles, simhash


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """Smallest id reachable, from {id: fingerprint}, by comparing all."""
    ids, values = list(fps), np.array(list(fps.values()), np.uint64)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= 4):
            a, b = root(i), root(ids[k + 1 + j])
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_fingerprints_and_components(docs, texts):
    found = simhash.near_duplicates(docs).collect()
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in found} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r.doc_id: r.component_id for r in found} == plain_components(fps)


def test_spark_hash_agrees(spark):
    from pyspark.sql import functions as F

    value = spark.range(1).select(F.xxhash64(F.lit("some four word shingle"))).first()[0]
    assert value % (1 << 64) == xxhash.xxh64_intdigest(b"some four word shingle", 42)


def test_any_four_positions_hold_a_triple():
    assert len(simhash.TRIPLES) == 20 and all(any(set(t) <= set(four) for t in simhash.TRIPLES) for four in simhash.FOURS)


def test_the_tally_drops_pairs_below_the_minimum():
    rng = random.Random(5)
    byte = lambda f, p: f >> 8 * p & 255
    fps = np.array([rng.getrandbits(40) << 24 | 0xABCDEF for _ in range(300)], np.uint64)  # one list by three bytes
    fps = np.unique(np.concatenate([fps, fps[:50] ^ np.uint64(1 << 30), fps[50:90] ^ np.uint64(0xF << 40), fps[90:120] ^ np.uint64(0x0101010101 << 24)]))
    pairs = [(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :]]
    a, b = (np.array(x, np.uint64) for x in zip(*pairs, strict=True))
    shared = simhash.tally(a, b)
    assert shared.tolist() == [sum(byte(int(x), p) == byte(int(y), p) for p in range(8)) for x, y in pairs]
    assert (shared == 3).sum() > 40_000 > 90 < (shared >= simhash.LEAST_SHARED).sum()  # most are dropped by the tally
    assert simhash.near(a, b).tolist() == [(int(x) ^ int(y)).bit_count() <= 4 for x, y in pairs]
    found = simhash._linked(np.zeros(len(fps), np.int64), fps)
    assert len(found[0]) >= 90 and all((int(x) ^ int(y)).bit_count() <= 4 for x, y in zip(*found[:2], strict=True))


def test_lists_are_whole_or_cut_by_size(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(simhash, "LIST_LIMIT", 40)
    names = np.sort(np.concatenate([np.arange(100), np.full(90, 7), np.full(39, 55), np.full(41, 56), np.full(30, 99)]))
    fps = np.arange(len(names)).astype(np.int64)
    for size in (1, 13, 64, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(names[k : k + size]), pa.array(fps[k : k + size])], names=["name", "fp"]) for k in range(0, len(names), size)]
        whole, long = {}, {}
        for n, f, is_whole in simhash._lists(iter(batches)):
            cut = simhash._linked(n, f)[2] if is_whole else np.ones(len(f), bool)
            for x, y, z in zip(n.tolist(), f.tolist(), cut, strict=True):
                (long if z else whole).setdefault(x, []).append(y)
        assert set(long) == {7, 56} and not set(long) & set(whole)
        assert sorted(sum([*whole.values(), *long.values()], [])) == fps.tolist()


@pytest.mark.parametrize("limit", [4_096, 20, 3])
def test_links_join_what_pairs_join(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "LIST_LIMIT", limit)
    monkeypatch.setattr(simhash, "SHORT", min(simhash.SHORT, limit))
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:12]:
        for _ in range(4):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                f ^= 1 << b
            fps.add(f)
    fps |= {(1 << 63) | (1 << k) for k in range(30)}  # a dense list
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for r in simhash.links(rows).collect():
        a, b = r.a % (1 << 64), r.b % (1 << 64)
        assert (a ^ b).bit_count() <= 8
        parent[root(a)] = root(b)
    expected = plain_components({f: f for f in fps})
    groups = {}
    for f in fps:
        groups.setdefault(root(f), set()).add(expected[f])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(expected.values()))


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    from tripweave.operators import joins

    monkeypatch.setattr(joins, "HOT_SHARE", 4)
    rows = spark.createDataFrame([(None if k % 2 else k % 30, k) for k in range(600)], "key int, v int")
    table = rows.groupBy("key").agg({"v": "max", "*": "count"}).toDF("key", "top", "n")
    best = {r.key: r.top for r in table.collect()}
    found = joins.join_counted(rows, table, ["key"], "n").collect()
    assert len(found) == 600 and all(r.top == best[r.key] for r in found)
    some = table.filter("key is null or key > 20")
    assert joins.join_counted(rows, some, ["key"], "n").count() == sum(1 for k in range(600) if k % 2 or k % 30 > 20)
    kept = joins.join_counted(rows, some, ["key"], "n", outer=True).collect()
    assert len(kept) == 600 and all((r.top is None) == (r.key is not None and r.key <= 20) for r in kept)


def plain_sets(texts, words=5):
    out = {}
    for i, t in texts.items():
        own = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w]
        out[i] = {tuple(own[k : k + words]) for k in range(len(own) - words + 1)} or ({tuple(own)} if own else set())
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_similar(texts, similarity=0.8):
    """Smallest id reachable over texts of that similarity, by comparing all."""
    sets, ids = plain_sets(texts), sorted(texts)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if min(len(sets[i]), len(sets[j])) >= similarity * max(len(sets[i]), len(sets[j])) and jaccard(sets[i], sets[j]) >= similarity:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def changed(rng, words, times):
    """The words with some of them, apart from each other, replaced."""
    words = list(words)
    for k in rng.sample(range(0, len(words) - 6, 6), times):
        words[k] = f"new{rng.getrandbits(30)}"
    return words


def test_wide_fingerprints():
    text = "The quick brown fox jumps over the lazy dog and runs far away from here to there"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 5]).encode(), 42) for k in range(len(words) - 4)]
    first = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    wide = simhash.wide_fingerprint(text.encode())
    assert len(wide) == 64 and int.from_bytes(wide[:8], "little") == first == simhash.fingerprint(text.encode(), 5)
    assert len({wide[k : k + 8] for k in range(0, 64, 8)}) == 8 and simhash.wide_fingerprint(b" ") == bytes(64) == simhash.wide_fingerprint(None)
    assert simhash.most_bits(1.0) == 0 and simhash.most_bits(0.8) == 77
    rng = random.Random(1)
    base = [f"w{rng.getrandbits(40)}" for _ in range(600)]
    differ = lambda a, b: int(np.bitwise_count(np.frombuffer(a, np.uint64) ^ np.frombuffer(b, np.uint64)).sum())
    for times in (2, 6, 12):
        other = changed(rng, base, times)
        own = plain_sets({0: " ".join(base), 1: " ".join(other)})
        bits = differ(*(simhash.wide_fingerprint(" ".join(x).encode()) for x in (base, other)))
        assert abs(bits - simhash.most_bits(jaccard(own[0], own[1]))) < simhash.SPREAD


@pytest.mark.parametrize("limit", [4_096, 8])
def test_similar_texts_are_found(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "LIST_LIMIT", limit)
    monkeypatch.setattr(simhash, "SHORT", min(limit, simhash.SHORT))
    rng, texts, expected = random.Random(8), {}, []
    for g in range(60):
        base = [f"w{rng.getrandbits(40)}" for _ in range(rng.choice((60, 200, 500)))]
        texts[len(texts)] = " ".join(base)
        for _ in range(3):
            other = changed(rng, base, rng.randint(1, max(1, len(base) // 45)))
            texts[len(texts)] = " ".join(other)
    for _ in range(40):  # one large group of like texts, and exact copies
        texts[len(texts)] = " ".join(changed(rng, base, 1))
        texts[len(texts)] = " ".join(base)
    sets, ids = plain_sets(texts), sorted(texts)
    pairs = [(i, j) for i in ids for j in range(i + 1, len(ids)) if len(sets[i] & sets[j]) and jaccard(sets[i], sets[j]) >= 0.8]
    found = {r.id: r for r in simhash.similar_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    caught = sum(found[i].component_id == found[j].component_id for i, j in pairs)
    assert len(pairs) > 3_000 and caught >= 0.98 * len(pairs)
    truth = plain_similar(texts)
    assert all(truth[i] == truth[r.component_id] for i, r in found.items())  # nothing is joined that isn't similar
    sizes = {}
    for r in found.values():
        sizes[r.component_id] = sizes.get(r.component_id, 0) + 1
    assert all(r.component_size == sizes[r.component_id] and r.component_id <= i for i, r in found.items())


def test_long_lists_are_compared_whole(spark, monkeypatch):
    """Pairs that share one posting list only, in which their words lie far apart."""
    monkeypatch.setattr(simhash, "LIST_LIMIT", 8)
    rng, rows = random.Random(4), []
    far = lambda x, y: int.bit_count(int.from_bytes(x[:8]) ^ int.from_bytes(y[:8])) > simhash.WORD_BITS
    while len(rows) < 120:
        one, pair = bytearray(rng.randbytes(64)), len(rows) // 2
        one[:8] = bytes(0 if p in simhash.TRIPLES[0] else rng.randrange(1, 256) for p in range(8))
        other = bytearray(one)
        for p in range(64):  # in the other words no three bytes are equal
            if (p < 8 and p not in simhash.TRIPLES[0]) or (p >= 8 and p % 8 < 6):
                other[p] ^= 0x80
        if all(far(x, r[1]) for x in (one, other) for r in rows):  # no chance neighbours
            rows += [(2 * pair, bytes(one), 2 * pair), (2 * pair + 1, bytes(other), 2 * pair + 1)]
    distinct = spark.createDataFrame(rows, "node long, fp binary, least long")
    texts = spark.createDataFrame([(r[0], "") for r in rows], "id long, text string")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "16")  # a list comes in several batches
    try:
        found = {(r.a, r.b) for r in simhash.similar_links(distinct, texts).collect()}
    finally:
        spark.conf.set(batch, before)
    assert found == {(2 * pair, 2 * pair + 1) for pair in range(60)}


def test_similar_on_odd_rows(odd, odd_rows, none):
    found = simhash.similar_components(odd).collect()
    assert len(found) == len(odd_rows)
    assert {r.component_id for r in found if r.id in (3, 4, 5)} == {3} and {r.component_id for r in found if r.id in (1, 2)} == {1} == {r.component_id for r in found if r.id == 1}
    assert {r.component_id for r in found if r.id in (6, 7)} == {6}
    assert simhash.similar_components(none).count() == 0


def test_simhash_on_odd_rows(odd, odd_rows, none):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == len(odd_rows)
    assert {r.fingerprint for r in found if r.doc_id in (3, 4, 5)} == {"0" * 16}
    assert {r.component_id for r in found if r.doc_id in (3, 4, 5)} == {3}
    assert {r.component_id for r in found if r.doc_id in (1, 2)} == {1}
    assert simhash.near_duplicates(none).count() == 0


def test_exact_groups(docs, texts):
    best, size = {}, {}
    for i, t in texts.items():
        best[t], size[t] = max(best.get(t, i), i), size.get(t, 0) + 1
    expected = {i: (best[t], size[t], best[t] == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items()}
    for block in (8192, 64):  # the smaller one names pairs over several levels
        found = exact_dedup.exact_duplicates(docs, block_bytes=block).collect()
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found} == expected and len(found) == len(expected)


@pytest.mark.parametrize("share", [2_000, 8])
def test_hot_blocks_keep_one_name(spark, monkeypatch, share):
    from tripweave.operators import joins

    monkeypatch.setattr(joins, "HOT_SHARE", share)
    rows = [(i, "same text" if i % 3 else f"text {i % 7}") for i in range(2_000)]
    found = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=4).collect()
    sizes = {}
    for i, t in rows:
        sizes[t] = sizes.get(t, 0) + 1
    assert {r.doc_id: r.group_size for r in found} == {i: sizes[t] for i, t in rows} and sum(r.kept for r in found) == len(sizes)


def test_exact_on_odd_rows(odd, odd_rows, none):
    found = exact_dedup.exact_duplicates(odd).collect()
    assert len(found) == len(odd_rows)
    plain = [r for r in found if r.keep_id == 2]
    assert len(plain) == 4 and {r.group_size for r in plain} == {4} and [r.doc_id for r in plain if r.kept] == [2]
    empty = [r for r in found if r.keep_id == 4]
    assert {r.doc_id for r in empty} == {3, 4, None} and sum(r.kept for r in empty) == 1
    assert sum(r.kept for r in found) == len({r[1] or "" for r in odd_rows})
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_repeated_rows_keep_one(spark):
    found = exact_dedup.exact_duplicates(spark.createDataFrame([(1, "a")] * 3, "doc_id long, text string")).collect()
    assert len(found) == 3 and sum(r.kept for r in found) == 1 and {r.group_size for r in found} == {3}


def test_oracle_names():
    assert "PARTITION BY" in oracles.exact_duplicates("documents")
