"""Product codes of vectors by Lloyd's rounds with Hamerly's bounds.

A vector's components become integers, its four equal parts are coded one by one.
Every row keeps, for each part, the entry it is assigned to, one upper bound on
the distance to it and one lower bound on the distance to the second nearest. A
round moves the bounds by how far entries went; only where upper < lower does not
hold strictly is the distance to the own entry made exact, and only where it
still does not hold are all entries scanned, with integers and the lower index at ties. As
bounds are rounded outwards, the codes are those of full scans.

Rows and bounds are stored after each round, sums and counts of entries go through
Spark as partial sums of tasks, and 4 x 256 entries through the driver.

Rows whose vector is null or holds null or non-finite components are dropped, as are
those of another length than the row with the smallest vec_id has (there is no common
codebook for them); a length that four does not divide raises ValueError. The first entries
are the parts of the smallest vec_ids, nulls last, equal ids by their components; fewer rows
give fewer entries. Components of more than 2**28 after scaling count as 2**28, so that
squares stay exact. Null labels are one label. Repeated rows count each; no rows give
no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import map_arrow, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LARGEST = 1 << 28
#: Bounds are rounded outwards by this share, far more than a double errs by.
SLACK = 1e-9
#: Labels whose sums are broadcast; more are joined by label and salt.
FEW_LABELS, SALTS = 100_000, 64
#: Rows whose distances to all entries are in memory at once.
SCAN_ROWS = 2_000


def integers(vectors: DataFrame, key: str, column: str, label: str) -> DataFrame:
    """vec_id, label and v, the integer components of the vectors that can be coded."""
    x = F.col(f"`{column}`")
    fine = x.isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    whole = F.transform(x, lambda c: F.greatest(F.least(F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(2.0**29)), F.lit(-(2.0**29)))), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    return vectors.filter(fine).select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"), whole.alias("v"))


class Codebook:
    """Entries of each part (parts x entries x dims) and how far each went in the last round."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        moved = np.zeros(entries.shape[:2]) if before is None else np.sqrt(((entries - before).astype(float) ** 2).sum(axis=2)) * (1 + SLACK)
        self.moved = moved
        order = np.argsort(moved, axis=1)
        self.farthest = order[:, -1]
        self.most = moved.max(axis=1)
        self.second = np.take_along_axis(moved, order, 1)[:, -2] if entries.shape[1] > 1 else np.zeros(len(entries))

    def exact(self, v: np.ndarray, part: int, at: np.ndarray) -> np.ndarray:
        """Squared distances of rows (n x dims) to one entry each."""
        off = v - self.entries[part][at]
        return (off * off).sum(axis=1)

    def scan(self, v: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest entry, its squared distance and that of the second nearest."""
        c = self.entries[part]
        small = max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) ** 2 * 4 * max(1, c.shape[1]) < 2**52
        kind = float if small else np.int64  # whole numbers below 2**52 are exact in both
        a, b = v.astype(kind), c.astype(kind)
        at, best, second = [], [], []
        for k in range(0, len(a), SCAN_ROWS):
            x = a[k : k + SCAN_ROWS]
            d = (x * x).sum(axis=1)[:, None] - 2 * (x @ b.T) + (b * b).sum(axis=1)
            n = d.argmin(axis=1)  # the first of equal ones
            at.append(n)
            best.append(d[np.arange(len(n)), n])
            d[np.arange(len(n)), n] = np.iinfo(np.int64).max if kind is np.int64 else np.inf
            second.append(d.min(axis=1).astype(float) if d.shape[1] > 1 else np.full(len(n), np.inf))
        return np.concatenate(at), np.concatenate(best).astype(np.int64), np.concatenate(second)

    def assign(self, v: np.ndarray, part: int, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """New entries and bounds of rows from those of the last round, and which rows were scanned."""
        upper = upper + self.moved[part][at] * (1 + SLACK)
        lower = lower - np.where(at == self.farthest[part], self.second[part], self.most[part]) * (1 + SLACK)
        open_ = np.flatnonzero(~(upper < lower))
        if len(open_):
            upper[open_] = np.sqrt(self.exact(v[open_], part, at[open_]).astype(float)) * (1 + SLACK)
            open_ = open_[~(upper[open_] < lower[open_])]
        if len(open_):
            found, best, second = self.scan(v[open_], part)
            at = at.copy()
            at[open_], upper[open_], lower[open_] = found, np.sqrt(best.astype(float)) * (1 + SLACK), np.sqrt(second) * (1 - SLACK)
        return at, upper, lower, open_


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def _first(rows: DataFrame, entries: int, parts: int) -> np.ndarray | None:
    """Entries to begin with; None without rows."""
    smallest = rows.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v")
    first = smallest.first()
    if first is None:
        return None
    dims = len(first.v)
    if dims % parts:
        raise ValueError(f"vectors of {dims} components have no {parts} equal parts")
    own = smallest.filter(F.size("v") == dims).limit(entries).collect()  # 256 rows
    return np.array([r.v for r in own], np.int64).reshape(len(own), parts, dims // parts).transpose(1, 0, 2)


def _state(kind: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("vec_id", T.LongType()),
            T.StructField("label", kind),
            T.StructField("v", T.ArrayType(T.IntegerType())),
            T.StructField("at", T.ArrayType(T.IntegerType())),
            T.StructField("upper", T.ArrayType(T.DoubleType())),
            T.StructField("lower", T.ArrayType(T.DoubleType())),
            T.StructField("scanned", T.IntegerType()),
        ]
    )


def _assigned(rows: DataFrame, book: Codebook, first: bool) -> DataFrame:
    """Rows with entry and bounds of each part; scanned is the number of parts scanned in full."""
    parts, _, width = book.entries.shape
    sent = rows.sparkSession.sparkContext.broadcast(book)  # entries of all parts only

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            n = batch.num_rows
            v = _matrix(batch.column(2), parts * width).reshape(n, parts, width)
            if first:
                at, upper, lower = np.zeros((n, parts), np.int64), np.full((n, parts), np.inf), np.zeros((n, parts))
            else:
                at, upper, lower = (c.flatten().to_numpy(zero_copy_only=False).reshape(n, parts).copy() for c in batch.columns[3:6])
            scanned = np.zeros(n, np.int32)
            for p in range(parts):
                at[:, p], upper[:, p], lower[:, p], full = own.assign(v[:, p], p, at[:, p], upper[:, p], lower[:, p])
                scanned[full] += 1
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, n * parts + 1, parts), pa.int32()), pa.array(x.reshape(-1), t)) for x, t in ((at, pa.int32()), (upper, pa.float64()), (lower, pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists, pa.array(scanned)], names=_state(T.NullType()).names)

    return map_arrow(rows, run, _state(rows.schema["label"].dataType))


def _moved(state: DataFrame, book: Codebook) -> Codebook:
    """The codebook whose entries are the means of their parts, rounded down; unused ones stay."""
    parts, entries, width = book.entries.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            n = batch.num_rows
            v = _matrix(batch.column(0), parts * width).reshape(n, parts, width)
            at = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, parts)
            for p in range(parts):
                np.add.at(sums[p], at[:, p], v[:, p])
                counts[p] += np.bincount(at[:, p], minlength=entries)
        used = np.argwhere(counts)
        values = [*sums[used[:, 0], used[:, 1]].T, counts[used[:, 0], used[:, 1]]]
        cells = np.stack(values, axis=1) if len(used) else np.empty((0, width + 1), np.int64)
        position = np.tile(np.arange(width + 1), len(used))
        yield pa.RecordBatch.from_pydict({"entry": np.repeat(used[:, 0] * entries + used[:, 1], width + 1), "position": position, "n": cells.reshape(-1)})

    partial = map_arrow(state.select("v", "at"), run, "entry long, position long, n long")
    sums = partial.groupBy("entry", "position").agg(F.sum(F.col("n").cast("decimal(19,0)")).alias("n"))
    total: dict[int, dict[int, int]] = {}
    for r in sums.collect():  # one number for each component of each entry, and its count
        total.setdefault(r["entry"], {})[r["position"]] = int(r["n"])
    new = book.entries.copy()
    for entry, cells in total.items():
        new[entry // entries, entry % entries] = [cells[k] // cells[width] for k in range(width)]
    return Codebook(new, book.entries)


def codebooks_sha256(entries: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, entries.reshape(-1).tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """vec_id, label, code, error and scanned (parts scanned in full in the last
    assignment) of each row, and the final entries (None without rows)."""
    rows = integers(vectors, key, column, label)
    entries_now = _first(rows, entries, parts)
    if entries_now is None:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).alias("scanned")), None
    _, k, width = entries_now.shape
    book, state = Codebook(entries_now), rows.filter(F.size("v") == parts * width)
    for step in range(rounds + 1):
        state = stored(_assigned(state, book, step == 0), f"codes-{step}")
        if step < rounds:
            book = _moved(state, book)
    sent = state.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            n = batch.num_rows
            v = _matrix(batch.column(2), parts * width).reshape(n, parts, width)
            at = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(n, parts)
            error = sum((own.exact(v[:, p], p, at[:, p]) for p in range(parts)), np.zeros(n, np.int64))
            code = [bytes(x).hex() for x in at.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(code, pa.string()), pa.array(error), batch.column(6)], names=["vec_id", "label", "code", "error", "scanned"])

    kind = rows.schema["label"].dataType
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", kind), T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("scanned", T.IntegerType())])
    return map_arrow(state, run, schema), book.entries


def with_label_error(coded: DataFrame, few: int = FEW_LABELS) -> DataFrame:
    """Rows with label_error, the sum of error over their label."""
    coded = stored(coded, "coded")
    sums = stored(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "labels")
    if sums.count() <= few:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    dealt = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    salted = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(salted.withColumnRenamed("_salt", "_own"), F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_own"))).drop("_label", "_salt", "_own")


def op13(vectors: DataFrame) -> DataFrame:
    coded, entries = encode(vectors)
    digest = codebooks_sha256(entries) if entries is not None else hashlib.sha256(b"").hexdigest()
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
