"""Token ids of a corpus as wavelet-matrix shards, each one compressed file.

Documents are dealt into ascending ranges of their id and encoded there; a range
is written as shards of about ``SHARD_TOKENS`` ids, cut between documents. A
shard keeps one bit-plane for each bit of the largest id, most significant
first: at each level ids with a zero bit come before those with a one, both in
order. A rank directory over 512-bit blocks makes access, counting and occurrence
lookup some steps a level; blocks of planes are compressed on their own, so a
lookup unpacks only those it meets.

The order is by doc_id, nulls first; equal ids are ordered by the hash of their
text and their place in the input, so that no id can fill one range alone. Null texts count as
empty: the end id alone. A document of any length stays in one shard. No rows
give no shards. Further columns are not read.

File: ``MAGIC``; an unsigned 32-bit length and a JSON header of that length
(tokens, docs, width, zeros of each plane, and place and size of each compressed
section); sections. Section "docs" holds doc ids, their null marks and ends; section
"ranks" the ones before each block of each plane; the others stretches of planes.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import map_arrow, shared_dir, stored
from tidemill.llm.tokens import tokenizer_path, word_ids

END_ID = 1
MAGIC = b"TMWM1\n"
SHARD_TOKENS = 1 << 21
#: Bits that one entry of the rank directory spans, and bytes of a plane packed as one section.
BLOCK, STRETCH = 512, 1 << 16
LEVEL = 1  # of compression


# One shard, in memory and as bytes.


def build(ids: np.ndarray, docs: np.ndarray, nulls: np.ndarray, ends: np.ndarray) -> bytes:
    """The file of one shard: ids in order; doc ids, null marks and ends of its documents."""
    n = len(ids)
    width = max(1, int(ids.max()).bit_length()) if n else 1
    order = ids.astype(np.uint16 if width <= 16 else np.uint32)
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    sections, places, zeros, ranks = [], [], [], []
    at = 0

    def add(raw: bytes) -> list[int]:
        nonlocal at
        sections.append(pack(raw))
        at += len(sections[-1])
        return [at - len(sections[-1]), len(sections[-1])]

    head = add(docs.astype("<i8").tobytes() + nulls.astype("u1").tobytes() + ends.astype("<i8").tobytes())
    for bit in range(width - 1, -1, -1):
        one = (order & (1 << bit)) != 0
        bits = np.packbits(one, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        ones = np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
        ranks.append(np.cumsum(ones, dtype=np.uint32) - ones)
        places.append([add(bits[k : k + STRETCH].tobytes()) for k in range(0, len(bits), STRETCH)])
        low = np.compress(~one, order)
        zeros.append(len(low))
        order = np.concatenate([low, np.compress(one, order)])
    rank_at = add(np.concatenate(ranks).astype("<u4").tobytes() if n else b"")
    header = json.dumps({"tokens": n, "docs": len(docs), "width": width, "zeros": zeros, "head": head, "planes": places, "ranks": rank_at}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *sections])


class Shard:
    """A wavelet matrix over one file's bytes; planes are unpacked as they are asked for."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("no shard of token ids")
        (size,) = struct.unpack_from("<I", data, len(MAGIC))
        start = len(MAGIC) + 4
        self._head = json.loads(data[start : start + size])
        self._data, self._base = memoryview(data), start + size
        self._unpack = zstandard.ZstdDecompressor().decompress
        self.tokens, self.docs, self.width = self._head["tokens"], self._head["docs"], self._head["width"]
        self._zeros = self._head["zeros"]
        self._stretches: dict[tuple[int, int], np.ndarray] = {}
        raw = self._section(self._head["head"])
        d = self.docs
        nulls = np.frombuffer(raw, "u1", d, 8 * d).astype(bool)
        self.doc_ids = [None if gone else int(x) for x, gone in zip(np.frombuffer(raw, "<i8", d), nulls)]
        self.ends = np.frombuffer(raw, "<i8", d, 9 * d)
        blocks = -(-self.tokens // BLOCK)
        self._ranks = np.frombuffer(self._section(self._head["ranks"]), "<u4").reshape(self.width, blocks)

    def _section(self, place: list[int]) -> bytes:
        at = self._base + place[0]
        return self._unpack(self._data[at : at + place[1]])

    def _stretch(self, level: int, k: int) -> np.ndarray:
        found = self._stretches.get((level, k))
        if found is None:
            self._stretches[level, k] = found = np.frombuffer(self._section(self._head["planes"][level][k]), np.uint8)
        return found

    def _bit(self, level: int, i: int) -> int:
        byte = i >> 3
        return int(self._stretch(level, byte // STRETCH)[byte % STRETCH]) >> (i & 7) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i >= self.tokens:
            return self.tokens - self._zeros[level]
        block = i // BLOCK
        first, last = block * (BLOCK // 8), i >> 3
        part = self._stretch(level, first // STRETCH)[first % STRETCH : first % STRETCH + last - first + 1]
        rest = int.from_bytes(part.tobytes(), "little") & ((1 << (i - block * BLOCK)) - 1)
        return int(self._ranks[level, block]) + rest.bit_count()

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of that kind in a plane."""
        before = self._ranks[level] if bit else np.arange(len(self._ranks[level]), dtype=np.int64) * BLOCK - self._ranks[level]
        block = int(np.searchsorted(before, k, side="right")) - 1
        first = block * (BLOCK // 8)
        bits = np.unpackbits(self._stretch(level, first // STRETCH)[first % STRETCH : first % STRETCH + BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        token = 0
        for level in range(self.width):
            bit = self._bit(level, i)
            ones = self._ones(level, i)
            i = self._zeros[level] + ones if bit else i - ones
            token = token << 1 | bit
        return token

    def _span(self, token: int, start: int, stop: int) -> tuple[int, int]:
        """Where the token's occurrences among positions start..stop lie below the last plane."""
        if token >> self.width:
            return 0, 0
        for level in range(self.width):
            a, b = self._ones(level, start), self._ones(level, stop)
            one = token >> (self.width - 1 - level) & 1
            start, stop = (self._zeros[level] + a, self._zeros[level] + b) if one else (start - a, stop - b)
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """How often the token occurs at positions start..stop, the end not included."""
        stop = self.tokens if stop is None else min(stop, self.tokens)
        if token < 0 or start >= stop:
            return 0
        first, past = self._span(token, start, stop)
        return past - first

    def select(self, token: int, k: int) -> int:
        """Position of the token's k-th occurrence, from 0; IndexError where it has fewer."""
        first, past = self._span(token, 0, self.tokens) if token >= 0 else (0, 0)
        if not 0 <= k < past - first:
            raise IndexError(k)
        at = first + k
        for level in range(self.width - 1, -1, -1):
            one = token >> (self.width - 1 - level) & 1
            at = self._select(level, one, at - self._zeros[level] if one else at)
        return at

    def occurrences(self, token: int) -> Iterator[int]:
        """Positions of the token, ascending."""
        return (self.select(token, k) for k in range(self.count(token)))

    def decode(self) -> np.ndarray:
        """All ids in order: planes are undone from the last to the first."""
        n = self.tokens
        ids = np.zeros(n, np.uint16 if self.width <= 16 else np.uint32)
        for level in range(self.width - 1, -1, -1):
            planes = self._head["planes"][level]
            packed = np.frombuffer(b"".join(self._section(p) for p in planes), np.uint8) if n else np.empty(0, np.uint8)
            one = np.unpackbits(packed, count=n, bitorder="little").view(bool)
            above = np.empty_like(ids)
            above[np.flatnonzero(~one)] = ids[: self._zeros[level]]
            above[np.flatnonzero(one)] = ids[self._zeros[level] :] | (1 << (self.width - 1 - level))
            ids = above
        return ids


# Files in the shared folder.


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Of a URI that executors and driver share; s3a is s3 here."""
    return pafs.FileSystem.from_uri("s3" + path[3:] if path.startswith("s3a:") else path)


def read_file(path: str) -> bytes:
    fs, place = filesystem(path)
    with fs.open_input_file(place) as f:
        return f.read()


_SHARD = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("shard", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("before", T.LongType()),
        T.StructField("tokens", T.LongType()),
        T.StructField("docs", T.LongType()),
    ]
)


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, ranges: int | None = None) -> DataFrame:
    """Write the shards of all documents into folder and return their list, stored:
    part (range), shard, path, tokens of the range before it, tokens, docs.

    A file has a name of its own for each try of a task; the list names those of the
    tries that counted, so a lost executor costs its range only.
    """
    tokenizer = tokenizer or tokenizer_path()
    folder = folder.rstrip("/")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(f"`{text_col}`").alias("tie"), F.monotonically_increasing_id().alias("nth"))
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first("id"), "tie", "nth"]
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, words, end = context.partitionId(), word_ids(tokenizer), struct.pack("<I", end_id)
        fs, place = filesystem(folder)
        held, ids, nulls, size, before, shard = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal held, ids, nulls, size, before, shard
            name = f"{part:06d}-{shard:06d}-{uuid.uuid4().hex}.wm"
            ends = np.cumsum([len(x) // 4 for x in held], dtype=np.int64)
            data = build(np.frombuffer(b"".join(held), "<u4"), np.array(ids, np.int64), np.array(nulls, bool), ends)
            with fs.open_output_stream(f"{place}/{name}") as f:
                f.write(data)
            row = {"part": [part], "shard": [shard], "path": [f"{folder}/{name}"], "before": [before], "tokens": [size], "docs": [len(ids)]}
            before, shard = before + size, shard + 1
            held, ids, nulls, size = [], [], [], 0
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("path", pa.string()), ("before", pa.int64()), ("tokens", pa.int64()), ("docs", pa.int64())]))

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = words.encode(text.as_py() or "") + end
                if held and size + len(found) // 4 > shard_tokens:
                    yield close()
                held.append(found)
                ids.append(doc or 0)
                nulls.append(doc is None)
                size += len(found) // 4
        if held:
            yield close()

    fs, place = filesystem(folder)
    fs.create_dir(place, recursive=True)
    return stored(map_arrow(dealt, run, _SHARD), "shards")


def starts(shards: DataFrame) -> DataFrame:
    """The list with ``first``: ids of all documents before the shard. One number for
    each range goes through the driver."""
    sums = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("tokens").alias("n")).collect()}
    first, rows = 0, []
    for part in sorted(sums):
        rows.append((part, first))
        first += sums[part]
    base = shards.sparkSession.createDataFrame(rows, "part int, base long")
    return shards.join(F.broadcast(base), "part").withColumn("first", F.col("base") + F.col("before")).drop("base")


def documents(shards: DataFrame) -> DataFrame:
    """Every document as the files have it: doc_id, start, n_tokens, ids_crc32."""
    listed = starts(shards).select("path", "first")
    dealt = listed.repartition(int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(*(c.to_pylist() for c in batch.columns)):
                shard = Shard(read_file(path))
                ids = shard.decode().astype("<u4")
                begin = np.concatenate([[0], shard.ends[:-1]]) if shard.docs else shard.ends
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begin.tolist(), shard.ends.tolist())]
                columns = [pa.array(shard.doc_ids, pa.int64()), pa.array(begin + first, pa.int64()), pa.array(shard.ends - begin, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(dealt, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """Each asked token's occurrences in each shard, by rank and select alone: token,
    path, n, and position of the first and last in the corpus (null where it has none)."""
    listed = starts(shards).select("path", "first")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(*(c.to_pylist() for c in batch.columns)):
                shard = Shard(read_file(path))
                n = [shard.count(t) for t in tokens]
                ends = [(first + shard.select(t, 0), first + shard.select(t, c - 1)) if c else (None, None) for t, c in zip(tokens, n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tokens, pa.int64()), pa.array([path] * len(tokens)), pa.array(n, pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*ends))],
                    names=["token", "path", "n", "earliest", "latest"],
                )

    return map_arrow(listed, run, "token long, path string, n long, earliest long, latest long")


def op11(docs: DataFrame) -> DataFrame:
    shards = write(docs, f"{shared_dir(docs.sparkSession)}/wavelet-{uuid.uuid4().hex}")
    return documents(shards)
