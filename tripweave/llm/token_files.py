"""Token ids of documents in binary shards with a minimal perfect hash index.

A shard holds the documents of a range of ids, in ascending order:

    payload    token ids, little-endian, 2 bytes each (4 for large vocabularies)
    ends       for each document, the place after its last id (8 bytes)
    displace   for each bucket of keys, a displacement, or -1 - slot (4 bytes)
    slots      for each different key: fingerprint (8), first document (8), documents (8)
    footer     JSON with the sections' sizes, its length (8 bytes), MAGIC

A key is looked up in constant time: its hash names a bucket, the bucket's
displacement names the slot, the slot's fingerprint tells whether the key is
in the shard, and the slot names the documents, whose ids are one slice.
"""

from __future__ import annotations

import bisect
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripweave.llm import encoders
from tripweave.llm.chunks import slices
from tripweave.sources.shared import new_path, written

MAGIC = b"TWTOKEN1"
BUCKET_KEYS = 2
#: A shard's share of all text, in bytes, is this at most (but for documents that are longer).
SHARD_BYTES = 256 << 20


def key_bytes(key) -> bytes:
    """A document key as bytes; None is a key of its own."""
    return b"\xff" if key is None else str(key).encode()


#: Displacements that are tried at once.
_TRIES = np.arange(64, dtype=np.uint64)
_STEP, _MIX1, _MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S30, _S27, _S31 = (np.uint64(x) for x in (30, 27, 31))


def _slots(keyed: np.ndarray, slots: int) -> np.ndarray:
    """Slots of numbers that join a key's hash and a displacement."""
    z = (keyed ^ (keyed >> _S30)) * _MIX1
    z = (z ^ (z >> _S27)) * _MIX2
    return ((z ^ (z >> _S31)) % np.uint64(slots)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of different keys: n keys take the slots 0 to n - 1, each its own.

    Buckets of about BUCKET_KEYS keys, largest first, look for a displacement that
    puts all their keys into free slots; buckets of one key take the slots left.
    """

    def __init__(self, seed: int, displace: np.ndarray, slots: int):
        self.seed, self.displace, self.slots = seed, displace, slots

    @classmethod
    def build(cls, keys: list[bytes]) -> PerfectHash:
        for seed in range(1000):
            if (found := cls._try(keys, seed)) is not None:
                return cls(seed, found, len(keys))
        raise ValueError("keys repeat")

    @staticmethod
    def _try(keys: list[bytes], seed: int) -> np.ndarray | None:
        n = len(keys)
        hashes = [xxhash.xxh64_intdigest(k, seed) for k in keys]
        if len(set(hashes)) < n:
            return None
        buckets: list[list[int]] = [[] for _ in range(max(1, -(-n // BUCKET_KEYS)))]
        for h in hashes:
            buckets[(h >> 32) % len(buckets)].append(h)
        displace = np.zeros(len(buckets), np.int32)
        taken = np.zeros(n, bool)
        free = None
        for b in sorted(range(len(buckets)), key=lambda b: -len(buckets[b])):
            if not buckets[b]:
                break
            if len(buckets[b]) == 1:
                free = free or iter(np.flatnonzero(~taken).tolist())
                displace[b] = -1 - next(free)
                continue
            own = np.array(buckets[b], np.uint64)
            for base in range(0, 1 << 20, len(_TRIES)):
                places = _slots(own[:, None] + (_TRIES + np.uint64(base)) * _STEP, n)
                for d in np.flatnonzero(~taken[places].any(axis=0)):
                    if len(set(places[:, d].tolist())) == len(own):
                        break
                else:
                    continue
                break
            else:
                return None
            displace[b] = base + d
            taken[places[:, d]] = True
        return displace

    def slots_of(self, keys: list[bytes]) -> np.ndarray:
        """Each key's slot; a key that isn't one of those the hash was built of gets some slot too."""
        if not keys or not self.slots:
            return np.zeros(len(keys), np.int64)
        hashes = np.array([xxhash.xxh64_intdigest(k, self.seed) for k in keys], np.uint64)
        d = self.displace[((hashes >> np.uint64(32)) % np.uint64(len(self.displace))).astype(np.int64)].astype(np.int64)
        return np.where(d < 0, -1 - d, _slots(hashes + np.maximum(d, 0).astype(np.uint64) * _STEP, self.slots))


def _fingerprint(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key, 0x5EED)


class ShardWriter:
    """Writes one shard; documents come in ascending order of their keys, equal keys side by side."""

    def __init__(self, uri: str, wide: bool):
        fs, path = pa.fs.FileSystem.from_uri(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = fs.open_output_stream(path)
        self.dtype = "<u4" if wide else "<u2"
        self.keys: list[bytes] = []
        self.counts: list[np.ndarray] = []

    def add(self, keys: list, ids: np.ndarray, counts: np.ndarray) -> None:
        self.out.write(np.ascontiguousarray(ids, self.dtype).tobytes())
        self.keys += map(key_bytes, keys)
        self.counts.append(counts)

    def close(self) -> tuple[int, int]:
        ends = np.cumsum(np.concatenate([np.zeros(0, np.int64), *self.counts]), dtype="<u8")
        first: dict[bytes, list[int]] = {}
        for place, key in enumerate(self.keys):
            first.setdefault(key, [place, 0])[1] += 1
        index = PerfectHash.build(list(first))
        slots = np.zeros((len(first), 3), "<u8")
        for slot, (key, (place, n)) in zip(index.slots_of(list(first)), first.items(), strict=True):
            slots[slot] = (_fingerprint(key), place, n)
        tokens = int(ends[-1]) if len(ends) else 0
        footer = json.dumps({"ids": self.dtype, "tokens": tokens, "documents": len(ends), "buckets": len(index.displace), "slots": len(slots), "seed": index.seed}).encode()
        for part in (ends.tobytes(), index.displace.astype("<i4").tobytes(), slots.tobytes(), footer, len(footer).to_bytes(8, "little"), MAGIC):
            self.out.write(part)
        self.out.close()
        return len(ends), tokens


class ShardReader:
    """Keyed access to a shard: documents(key) gives the ids of each document with that key."""

    def __init__(self, uri: str):
        fs, path = pa.fs.FileSystem.from_uri(uri)
        size = fs.get_file_info(path).size
        self.file = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"not a token shard: {uri}")
        length = int.from_bytes(tail[:8], "little")
        self.about = json.loads(self.file.read_at(length, size - 16 - length))
        self.width = np.dtype(self.about["ids"]).itemsize
        at = self.about["tokens"] * self.width
        self.ends = self._array("<u8", self.about["documents"], at)
        at += self.ends.nbytes
        displace = self._array("<i4", self.about["buckets"], at)
        at += displace.nbytes
        self.slots = self._array("<u8", self.about["slots"] * 3, at).reshape(-1, 3)
        self.index = PerfectHash(self.about["seed"], displace, self.about["slots"])

    def _array(self, dtype: str, n: int, at: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(n * np.dtype(dtype).itemsize, at), dtype)

    def ids(self, place: int) -> np.ndarray:
        start = int(self.ends[place - 1]) if place else 0
        return self._array(self.about["ids"], int(self.ends[place]) - start, start * self.width)

    def places(self, keys: list) -> list[range]:
        """Each key's documents, by place in the shard; none if it is not there."""
        if not len(self.slots):
            return [range(0)] * len(keys)
        names = [key_bytes(k) for k in keys]
        rows = self.slots[self.index.slots_of(names)].tolist()
        return [range(p, p + n) if f == _fingerprint(name) else range(0) for name, (f, p, n) in zip(names, rows, strict=True)]

    def documents(self, key) -> list[np.ndarray]:
        return [self.ids(p) for p in self.places([key])[0]]


def shards_of(docs: DataFrame, text_col: str, shard_bytes: int) -> int:
    """How many shards are written: one a task, and as many more as the bytes of all texts ask for (with 16 for each row)."""
    total = docs.agg(F.sum(F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) + F.lit(16).cast("long"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_bytes))


def write_token_files(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end: int = 0, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes every whole text and writes shards in ascending id order; returns their manifest.

    Manifest: shard, path, first_id and last_id (both inclusive), documents, tokens, start (ids of all shards before).

    A null text counts as empty (only the end id), a null id comes first, rows that repeat an id stand
    side by side ordered by a hash of the text, and other columns aren't read. An empty table gives no shard.
    Rows are dealt by ranges of id and that hash, so the texts move once and an id that many rows
    share may go on over several shards. There are as many shards as tasks, and more where one would hold over shard_bytes of text, so what
    a task holds of a shard (its keys and their index) is bounded by that. An attempt at a task writes a file
    of its own name, and the manifest, which is written once, names those of the attempts that
    counted: a lost executor or a second attempt leaves no mixed shard.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    n = shards_of(docs, text_col, shard_bytes)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("hash"))
    kind = rows.schema["id"].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, ends = TaskContext.get(), None, []
        uri = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.tokens"
        for batch in batches:
            for part in slices(batch, "text"):
                enc = encoders.encoder(vocabulary)
                out = out or ShardWriter(uri, enc.tokenizer.get_vocab_size() > 1 << 16)
                ids, counts = enc.encode(part.column(1), end)
                keys = part.column(0).to_pylist()
                out.add(keys, ids, counts)
                ends = [*ends[:1], keys[-1]] if ends else [keys[0], keys[-1]]
        if out:
            found = out.close()
            schema = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("first_id", batch.column(0).type), ("last_id", batch.column(0).type), ("documents", pa.int64()), ("tokens", pa.int64())])
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (task.partitionId(), uri, *ends, *found), strict=True))], schema=schema)

    dealt = rows.repartitionByRange(n, F.col("id").asc_nulls_first(), "hash").sortWithinPartitions(F.col("id").asc_nulls_first(), "hash", "text")
    shards = written(dealt.select("id", "text").mapInArrow(kernel, f"shard long, path string, first_id {kind}, last_id {kind}, documents long, tokens long"), "manifest")
    before = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row per shard
    return shards.withColumn("start", F.coalesce(before, F.lit(0)))


def read_token_files(manifest: DataFrame, docs: DataFrame, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Looks up each id of docs in the shards: id, start, n_tokens, ids_crc32, ids of every document found.

    ids is the array of token ids (empty without with_ids). The manifest (a row per shard, as many as there were
    tasks) tells which shards may hold a key. A shard's keys go to one task, which looks them up in its index; rows
    that ask for the same key get its documents once.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shards = manifest.orderBy("shard").collect()
    ranges = [(r.path, _order(r.first_id), _order(r.last_id), r.start) for r in shards]

    def addressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lasts = [r[2] for r in ranges]
        for batch in batches:
            at, keys = [], []
            for key in batch.column(0).to_pylist():
                k = bisect.bisect_left(lasts, _order(key))
                while k < len(ranges) and ranges[k][1] <= _order(key):
                    at.append(k)
                    keys.append(key)
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(keys, batch.column(0).type)], names=["at", "id"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, now = None, None
        for batch in batches:
            rows, held = {k: [] for k in ("id", "start", "n_tokens", "ids_crc32", "ids")}, 0
            wanted = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for at, own in itertools.groupby(wanted, lambda x: x[0]):
                if at != now:
                    reader, now = ShardReader(ranges[at][0]), at
                keys = [key for _, key in own]
                for key, found in zip(keys, reader.places(keys), strict=True):
                    for place in found:
                        ids = reader.ids(place)
                        rows["id"].append(key)
                        rows["start"].append(ranges[at][3] + (int(reader.ends[place - 1]) if place else 0))
                        rows["n_tokens"].append(len(ids))
                        rows["ids_crc32"].append(encoders.crc32(ids))
                        rows["ids"].append(ids.astype(np.int32) if with_ids else [])
                        held += len(ids)
                        if held > 1 << 21:
                            yield _found(rows, batch.schema.field(1).type)
                            rows, held = {k: [] for k in rows}, 0
            yield _found(rows, batch.schema.field(1).type)

    keys = docs.select(F.col(id_col).alias("id")).distinct()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.mapInArrow(addressed, f"at long, id {kind}").repartition(n, "at").sortWithinPartitions("at", F.col("id").asc_nulls_first())
    found = dealt.mapInArrow(kernel, f"id {kind}, start long, n_tokens long, ids_crc32 long, ids array<int>")
    return found.withColumnRenamed("id", id_col)


def _order(key) -> tuple:
    """Sorts None before all other keys."""
    return (key is not None, key)


def _found(rows: dict, kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], names=list(rows))
