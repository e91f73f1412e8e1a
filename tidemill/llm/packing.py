"""Packing tokenised documents into sequences by linear grouping and best fit.

Every document becomes its token ids and an end id; one longer than a sequence
is cut into pieces of full length. What is planned is the histogram of piece
lengths, which the sequence length bounds, so the plan is a small table
whatever the corpus: large lengths are rounded up within groups of equal
cardinality, a linear programme over the few sizes left picks configurations,
actual pieces take their slots in order of length, and what remains goes to the
fullest sequence that still holds it. Spark numbers the pieces of each length
and looks their places up in the plan.

Null texts count as empty ones: a piece with the end id alone. Repeated rows
are packed as often as they occur; no rows give no sequences. Very long texts are
cut into as many pieces as they need; only the last is in competition for room.
Equal lengths are placed by task and order of reading, so which of them goes where
may differ from run to run, never how many sequences there are. Carried columns
travel inside a struct, so a further column may have any name.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemill.llm.common import map_arrow, stored
from tidemill.llm.tokens import CACHE_PARTS, WordIds, tokenizer_path, word_ids  # noqa: F401

SEQUENCE = 2048
END_ID = 0
#: What is planned, as (a sequence's share from which a length is large, groups);
#: the plan with the fewest sequences is taken.
PLANS = ((2, 16), (3, 8), (4, 8), (8, 16))


_PIECE = T.StructType(
    [
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("task", T.IntegerType()),
        T.StructField("nth", T.LongType()),
    ]
)


def pieces(
    docs: DataFrame, carry: list[str], text_col: str = "text", path: str | None = None, sequence: int = SEQUENCE, remembered: int = CACHE_PARTS
) -> DataFrame:
    """A row for each piece: struct ``row`` with the carried columns and the piece's
    number, start, length and checksum. (task, length, nth) number the pieces."""
    path = path or tokenizer_path()
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([inner.schema["row"], *_PIECE.fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        from pyspark import TaskContext

        words, task, seen, end = None, TaskContext.get().partitionId(), [0] * (sequence + 1), struct.pack("<I", END_ID)
        for batch in batches:
            words = words if words is not None else word_ids(path, remembered)
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                took, rows = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = words.encode(text or "") + end
                    for n, start in enumerate(range(0, len(ids), 4 * sequence)):
                        cut = ids[start : start + 4 * sequence]
                        length = len(cut) // 4
                        took.append(i)
                        rows.append((n, start // 4, length, zlib.crc32(cut), task, seen[length]))
                        seen[length] += 1
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(took)), *columns], names=["row", *_PIECE.names]
                )

    return map_arrow(inner, run, schema)


# The plan: on the driver, over at most `sequence` lengths.


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], float]]:
    """The linear programme of least sequences over few sizes, by column generation."""
    k = len(sizes)
    columns = np.diag([float(capacity // s) for s in sizes])
    for _ in range(40 * k):
        inverse = np.linalg.inv(columns)
        x = inverse @ np.array(demand, dtype=float)
        price = inverse.sum(axis=0)  # each sequence costs one
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for g in range(k):  # unbounded knapsack over the prices
            if price[g] > 1e-12:
                for c in range(sizes[g], capacity + 1):
                    if best[c - sizes[g]] + price[g] > best[c] + 1e-12:
                        best[c], last[c] = best[c - sizes[g]] + price[g], g
        at = int(best.argmax())
        if best[at] <= 1 + 1e-7:
            break
        new = np.zeros(k)
        while last[at] >= 0:
            g = int(last[at])
            new[g] += 1
            at -= sizes[g]
        step = inverse @ new
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        columns[:, int(ratio.argmin())] = new
    x = np.linalg.inv(columns) @ np.array(demand, dtype=float)
    return [(columns[:, j].astype(int).tolist(), float(x[j])) for j in range(k)]


class Plan:
    """Places of all pieces: rows (length, first, past, sequence, each, offset).

    The piece of that length with number r in first..past goes to sequence +
    (r - first) // each, at offset + (r - first) % each * length.
    """

    def __init__(self, histogram: dict[int, int], capacity: int, share: int, groups: int):
        self.capacity, self.rows, self.sequences = capacity, [], 0
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first, count)
        self.left = {n: [(0, c)] for n, c in sorted(histogram.items(), reverse=True) if c}  # numbers not yet placed
        self._large(histogram, share, groups)
        for length in list(self.left):
            for first, past in self.left[length]:
                self._best_fit(length, first, past)

    def _large(self, histogram: dict[int, int], share: int, groups: int) -> None:
        """Lengths over that share of a sequence: rounded up in groups, then configured."""
        lengths = sorted((n for n, c in histogram.items() if c and n > self.capacity // share), reverse=True)
        total = sum(histogram[n] for n in lengths)
        if not total:
            return
        runs: list[list[tuple[int, int, int]]] = [[]]  # of each group: (length, first, past)
        room = members = -(-total // groups)
        for n in lengths:
            first = 0
            while first < histogram[n]:
                if not room:
                    runs.append([])
                    room = members
                take = min(room, histogram[n] - first)
                runs[-1].append((n, first, first + take))
                first, room = first + take, room - take
        merged: dict[int, list[tuple[int, int, int]]] = {}  # groups rounded to the same size are one
        for run in runs:
            merged.setdefault(run[0][0], []).extend(run)
        sizes = list(merged)
        demand = [sum(b - a for _, a, b in merged[s]) for s in sizes]
        for n in lengths:
            self.left[n] = []
        queue = {s: list(merged[s]) for s in sizes}
        for config, times in configurations(sizes, demand, self.capacity):
            slots = [s for s, a in zip(sizes, config) for _ in range(a)]
            have = {s: sum(b - a for _, a, b in queue[s]) for s in set(slots)}
            times = min([int(times + 1e-6), *(have[s] // slots.count(s) for s in have)])
            if times > 0 and slots:
                self._substitute([self._take(queue[s], times) for s in slots], times)
        for rest in queue.values():
            for n, a, b in rest:
                self.left[n].append((a, b))

    @staticmethod
    def _take(queue: list[tuple[int, int, int]], count: int) -> list[tuple[int, int, int]]:
        out = []
        while count:
            n, a, b = queue.pop(0)
            if b - a > count:
                queue.insert(0, (n, a + count, b))
                b = a + count
            out.append((n, a, b))
            count -= b - a
        return out

    def _substitute(self, slots: list[list[tuple[int, int, int]]], times: int) -> None:
        """Fill ``times`` sequences; a stretch in which no slot's length changes is a class."""
        cuts = {0, times}
        for slot in slots:
            at = 0
            for _, a, b in slot:
                cuts.add(at := at + b - a)
        cuts = sorted(cuts)
        heads = [0] * len(slots)
        spans = [list(slot) for slot in slots]
        for lo, hi in zip(cuts, cuts[1:]):
            offset = 0
            for j, slot in enumerate(spans):
                n, a, b = slot[heads[j]]
                self.rows.append((n, a, a + hi - lo, self.sequences, 1, offset))
                offset += n
                slot[heads[j]] = (n, a + hi - lo, b)
                heads[j] += a + hi - lo == b
            self.open[self.capacity - offset].append((self.sequences, hi - lo))
            self.sequences += hi - lo

    def _best_fit(self, length: int, first: int, past: int) -> None:
        room = length
        while first < past:
            while room <= self.capacity and not self.open[room]:
                room += 1
            if room > self.capacity:
                room = self.capacity
                count = -(-(past - first) // (room // length))
                self.open[room].append((self.sequences, count))
                self.sequences += count
            base, count = self.open[room].pop()
            each = room // length
            full = min(count, (past - first) // each)
            if full:
                self._put(length, first, first + full * each, base, each, room, full)
                first += full * each
            if full < count:
                odd = past - first  # fewer than a whole sequence takes
                if odd:
                    self._put(length, first, past, base + full, odd, room, 1)
                    first = past
                if count - full - bool(odd):
                    self.open[room].append((base + full + bool(odd), count - full - bool(odd)))

    def _put(self, length, first, past, base, each, room, count) -> None:
        self.rows.append((length, first, past, base, each, self.capacity - room))
        self.open[room - each * length].append((base, count))


def plan(histogram: dict[int, int], capacity: int = SEQUENCE) -> Plan:
    return min((Plan(histogram, capacity, *x) for x in PLANS), key=lambda p: p.sequences)


def pack(
    docs: DataFrame, carry: list[str], text_col: str = "text", path: str | None = None, sequence: int = SEQUENCE, remembered: int = CACHE_PARTS
) -> DataFrame:
    """Struct ``row`` with the carried columns, and piece, start, length, ids_crc32,
    sequence_id and offset of every piece."""
    spark = docs.sparkSession
    found = stored(pieces(docs, carry, text_col, path, sequence, remembered), "pieces")
    by_task = found.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # at most `sequence` lengths went in, so the places are a small table too; an Arrow table,
    # as a list would start a second group of Python workers on each executor
    rows, names = plan(histogram, sequence).rows if histogram else [], ["length", "first", "past", "base", "each", "at"]
    places = spark.createDataFrame(pa.table({c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate(names)}))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = found.join(starts, ["task", "length"]).withColumn("number", F.col("before") + F.col("nth"))
    placed = numbered.join(
        F.broadcast(places.withColumnRenamed("length", "of")),
        (F.col("length") == F.col("of")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("past")),
    )
    step = F.col("number") - F.col("first")
    return placed.select(
        "row",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("base") + F.floor(step / F.col("each"))).alias("sequence_id"),
        (F.col("at") + step % F.col("each") * F.col("length")).alias("offset"),
    )


def op2(docs: DataFrame, remembered: int = CACHE_PARTS) -> DataFrame:
    rest = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return pack(docs, ["doc_id"], remembered=remembered).select("row.doc_id", *rest)
