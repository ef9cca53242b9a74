"""Token ids as shard files with a minimal perfect hash index for keyed access.

Documents are dealt in key order to tasks, each of which writes a shard in the shared folder: raw ids, one
text after another, and an index that maps a key to its entry in constant time. The index keeps no keys to
search: a displacement for each bucket of keys sends every key to its own slot, which holds a fingerprint,
the offset and the length. Every attempt of a task writes files of its own; the manifest, which Spark commits
once for each task, names those that count, so a task that runs again never meets the files of another attempt.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest

from .common import n_partitions, shared_dir, stored

MAGIC = b"TNIDX001"
#: magic, entries, buckets, seed, bytes of an id
HEADER = struct.Struct("<8sQQQQ")
SLOT = np.dtype([("print", "<u4"), ("start", "<u8"), ("n", "<u8")])
ENTRY = struct.Struct("<IQQ")
#: Bytes of text of a shard on average, if that makes no fewer shards than tasks and at most MOST_SHARDS.
SHARD_BYTES, MOST_SHARDS = 256 << 20, 20_000
#: What a row weighs beside its text, so that no shard has more keys than a task indexes in a minute (a quarter of a million).
ROW_BYTES = 1024
#: Bytes that a reader asks for at a time.
BLOCK = 4 << 20
KEYS_A_BUCKET = 4
#: Pieces of text in a generation of the encoder's cache: about 200 bytes each, two generations a worker.
CACHED = 800_000
MASK = (1 << 64) - 1


def key_bytes(doc_id: int | None, repeat: int) -> bytes:
    """A key of the index: the document's and how many rows before it have the same."""
    return f"{doc_id}#{repeat}".encode()


def place(h: int, displacement: int, n: int) -> int:
    """The slot of a key's 128-bit hash under its bucket's displacement; negative ones name the slot."""
    if displacement < 0:
        return -displacement - 1
    x = (h >> 64) + displacement * 0x9E3779B97F4A7C15 & MASK
    x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & MASK
    return (x ^ x >> 29) % n


class PerfectHash:
    """Hash and displace: large buckets first look for a displacement under which all their keys find free slots."""

    def __init__(self, keys: list[bytes]):
        self.n, self.seed = len(keys), 0
        while not self.build(keys):
            self.seed += 1

    def build(self, keys: list[bytes]) -> bool:
        n, m = self.n, max(1, self.n // KEYS_A_BUCKET)
        hashes = [xxh3_128_intdigest(k, self.seed) for k in keys]
        buckets = defaultdict(list)
        for h in hashes:
            buckets[(h & MASK) % m].append(h)
        taken, self.displacements = bytearray(n), np.zeros(m, "<i8")
        free = None
        for b, own in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(own) == 1:
                free = iter([i for i in range(n) if not taken[i]]) if free is None else free
                self.displacements[b] = -next(free) - 1
                continue
            for d in range(1 << 20):
                slots = {place(h, d, n) for h in own}
                if len(slots) == len(own) and not any(taken[s] for s in slots):
                    break
            else:
                return False
            self.displacements[b] = d
            for s in slots:
                taken[s] = 1
        self.slots = [place(h, int(self.displacements[(h & MASK) % m]), n) for h in hashes]
        self.prints = [h >> 96 for h in hashes]
        return True


def index_bytes(keys: list[bytes], starts: list[int], lengths: list[int], width: int) -> bytes:
    phf = PerfectHash(keys) if keys else None
    slots = np.zeros(len(keys), SLOT)
    if phf:
        slots["print"][phf.slots], slots["start"][phf.slots], slots["n"][phf.slots] = phf.prints, starts, lengths
    d = phf.displacements if phf else np.zeros(0, "<i8")
    return HEADER.pack(MAGIC, len(keys), len(d), phf.seed if phf else 0, width) + d.tobytes() + slots.tobytes()


class Index:
    """Constant-time access by key to a shard's entries, which stay as they are in the file."""

    def __init__(self, data: bytes):
        magic, self.n, self.m, self.seed, self.width = HEADER.unpack_from(data)
        if magic != MAGIC or len(data) != HEADER.size + 8 * self.m + SLOT.itemsize * self.n:
            raise ValueError("not an index of token shards")
        self.data, self.slots = data, HEADER.size + 8 * self.m
        self.displacements = memoryview(data)[HEADER.size : self.slots].cast("q")

    def find(self, key: bytes) -> tuple[int, int] | None:
        """start and length in ids; None for a key that isn't there (but for one in 2^32, whose fingerprint is equal)."""
        if not self.n:
            return None
        h = xxh3_128_intdigest(key, self.seed)
        s = place(h, self.displacements[(h & MASK) % self.m], self.n)
        mark, start, n = ENTRY.unpack_from(self.data, self.slots + ENTRY.size * s)
        return (start, n) if mark == h >> 96 else None


class Payload:
    """A shard's ids, of which the block around the last ones read is held."""

    def __init__(self, folder: str, name: str, width: int):
        system, path = file_system(folder)
        self.file, self.width, self.at, self.block = system.open_input_file(f"{path}/{name}"), width, 0, b""

    def ids(self, start: int, n: int) -> np.ndarray:
        lo, size = start * self.width, n * self.width
        if lo < self.at or lo + size > self.at + len(self.block):
            self.at, self.block = lo, self.file.read_at(max(size, BLOCK), lo)
        return np.frombuffer(self.block, f"<u{self.width}", n, lo - self.at)


def file_system(folder: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    return system, path


def write_file(folder: str, name: str, parts: Iterator[bytes]) -> None:
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{name}") as out:
        for p in parts:
            out.write(p)


def read_file(folder: str, name: str) -> bytes:
    system, path = file_system(folder)
    with system.open_input_file(f"{path}/{name}") as f:
        return f.read()


def keyed(docs: DataFrame, column: str) -> DataFrame:
    """doc_id, raw (XXH64 of the text, by which rows with one key are dealt) and text."""
    text = F.coalesce(F.col(column), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("raw"), text.alias("text"))


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, column: str = "text", shards: int | None = None) -> DataFrame:
    """Writes the shards; a row for each: shard, file (its name without ending), first_doc, first_raw, docs, ids."""
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    spark = docs.sparkSession
    if not shards:
        size = docs.agg(F.sum(F.coalesce(F.octet_length(column), F.lit(0)).cast("bigint") + ROW_BYTES)).first()[0] or 0
        shards = max(n_partitions(spark), min(MOST_SHARDS, size // SHARD_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .tokens import encoder

        context = TaskContext.get()
        shard = context.partitionId()
        name = f"{shard:06d}-{context.taskAttemptId()}"
        own, end = encoder(tokenizer, CACHED), end_id.to_bytes(4, "little")
        keys, starts, lengths, total, repeat, first, last = [], [], [], 0, 0, None, ()

        def payload() -> Iterator[bytes]:
            nonlocal total, repeat, first, last
            for batch in batches:
                for doc, raw, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), own.encode(batch.column(2))):
                    ids += end
                    first = first or (doc, raw)
                    repeat = repeat + 1 if last == doc else 0
                    last = doc
                    keys.append(key_bytes(doc, repeat))
                    starts.append(total)
                    lengths.append(len(ids) // 4)
                    total += len(ids) // 4
                    yield np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()

        write_file(folder, f"{name}.ids", payload())
        write_file(folder, f"{name}.idx", iter([index_bytes(keys, starts, lengths, width)]))
        if keys:
            columns = (shard, pa.int32()), (name, pa.string()), (first[0], pa.int64()), (first[1], pa.int64()), (len(keys), pa.int64()), (total, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in columns], ["shard", "file", "first_doc", "first_raw", "docs", "ids"])

    order = F.col("doc_id").asc_nulls_first(), F.col("raw")
    dealt = keyed(docs, column).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    return stored(dealt.mapInArrow(run, "shard int, file string, first_doc bigint, first_raw bigint, docs bigint, ids bigint"), "manifest")


def ordered(doc: int | None, raw: int) -> tuple[bool, int, int]:
    """A key of the order in which rows are written."""
    return doc is not None, doc or 0, raw


def read_shards(docs: DataFrame, manifest: DataFrame, folder: str, column: str = "text") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, read back from the shards by their indexes.

    A row is sent to the shard whose range holds its key and text's hash; shards follow one another in this
    order, so a document's start is its shard's and its own together.
    """
    spark = docs.sparkSession
    shards, base = [], 0
    for r in manifest.orderBy("shard").collect():  # a row for each shard
        shards.append((ordered(r["first_doc"], r["first_raw"]), r["file"], base))
        base += r["ids"]
    bounds = spark.sparkContext.broadcast(shards)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [s[0] for s in bounds.value]
        for batch in batches:
            at = [max(0, bisect_right(firsts, ordered(*k)) - 1) for k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(0), batch.column(1)], ["shard", "doc_id", "raw"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index, payload, last, repeat, before = None, None, None, (), 0, 0
        for batch in batches:
            rows = []
            for shard, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if shard != now:
                    _, name, before = bounds.value[shard]
                    now, index, last = shard, Index(read_file(folder, f"{name}.idx")), ()
                    payload = Payload(folder, f"{name}.ids", index.width)
                repeat = repeat + 1 if last == doc else 0
                last = doc
                start, n = index.find(key_bytes(doc, repeat))
                rows.append((doc, before + start, n, crc32(payload.ids(start, n).astype("<u4"))))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 4)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    routed = keyed(docs, column).select("doc_id", "raw").mapInArrow(route, "shard int, doc_id bigint, raw bigint")
    dealt = routed.repartition(max(1, min(len(shards), MOST_SHARDS)), "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "raw")
    return dealt.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2, column: str = "text", folder: str | None = None, shards: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, from files written and read back.

    Null counts as empty text, which is the end id alone; long texts are encoded whole. Null keys come first;
    rows that repeat a key follow one another in the order of their texts' hashes, over several shards where they
    are many. An empty table writes no entries and gives no rows. Other columns are not read.
    """
    folder = folder or shared_dir(docs.sparkSession, "shards")
    return read_shards(docs, write_shards(docs, tokenizer, folder, end_id, column, shards), folder, column)
